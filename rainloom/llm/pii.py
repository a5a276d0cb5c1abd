"""Personal data: detection, and keyed surrogates that stay true to type and format.

Detected are e-mail addresses, telephone numbers, card numbers that pass the Luhn test, account numbers (IBAN) that pass theirs, social security numbers, IPv4 and IPv6 addresses, and names: behind
a title or a known first name, behind a phrase that introduces one, or before the person's e-mail address; and every further mention of such a name in its text that begins with a capital (or in a
script without them). A surrogate depends on a key, the kind and the canonical value, so one person's data get the same surrogate
in every text (coreference). A first name's gender is that of the list, else the one that most titles before it in all texts say. A surrogate keeps the format: digits stay digits, letters keep case and script, separators stay, card and account numbers pass their tests,
addresses are addresses, first names come from names of the same gender and script. Names in scripts without a list or syllables here get other letters of their script, kind by kind; marks stay.

Distinctness is checked over all distinct entities: where two values would get one surrogate, or a surrogate is a value that
occurs itself, all but the smallest value draw again, until no two share one. Such redraws are rare; up to `redraw_bound` of them
are sent to the tasks, more are joined to the documents that hold them. Draws widen with the attempts (names and addresses by letters from the eighth on, telephone numbers by a digit from the
64th on), so that values of one short form find surrogates however many they are; kinds of fixed length have over 10**8 values, and a job whose draws run out at MOST attempts stops with an error.

Cases: null texts stay null, empty texts empty; overlapping detections keep the leftmost, then the longest; repeated rows are treated alike; other columns are
kept as they are, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hmac
import ipaddress
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rainloom.llm.common import stash

# Titles and first names by gender and script.
TITLES = {
    "m": ("Mr", "Herr", "Monsieur", "Señor", "Sr", "господин", "Κύριος", "السيد", "श्री", "מר"),
    "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "госпожа", "Κυρία", "السيدة", "श्रीमती", "גברת"),
    "n": ("Dr", "Prof"),
}
CUES = ("my name is", "name:", "contact:", "signed,", "signed by", "sincerely,", "written by", "author:", "mein Name ist", "je m'appelle", "me llamo", "меня зовут")
NAMES = {
    ("m", "LATIN"): ("James", "John", "Robert", "Michael", "William", "David", "Thomas", "Daniel", "Hans", "Peter", "Klaus", "Jean", "Pierre", "Luis", "Carlos", "Jorge", "Miguel", "Stefan", "Marco", "Henry"),
    ("f", "LATIN"): ("Mary", "Anna", "Emma", "Julia", "Laura", "Sarah", "Maria", "Sophie", "Claire", "Marie", "Carmen", "Elena", "Ingrid", "Helga", "Petra", "Alice", "Emily", "Olivia", "Lucia", "Irene"),
    ("m", "CYRILLIC"): ("Иван", "Пётр", "Сергей", "Алексей", "Дмитрий", "Николай", "Михаил", "Андрей", "Олег", "Павел"),
    ("f", "CYRILLIC"): ("Анна", "Мария", "Елена", "Ольга", "Наталья", "Ирина", "Татьяна", "Светлана", "Юлия", "Вера"),
    ("m", "GREEK"): ("Γιώργος", "Δημήτρης", "Κώστας", "Νίκος", "Γιάννης", "Παναγιώτης"),
    ("f", "GREEK"): ("Μαρία", "Ελένη", "Κατερίνα", "Σοφία", "Άννα", "Βασιλική"),
    ("m", "ARABIC"): ("محمد", "أحمد", "علي", "حسن", "خالد", "يوسف"),
    ("f", "ARABIC"): ("فاطمة", "مريم", "عائشة", "زينب", "ليلى", "سارة"),
    ("m", "DEVANAGARI"): ("राजेश", "अमित", "सुनील", "विजय", "अनिल", "रवि"),
    ("f", "DEVANAGARI"): ("सुनीता", "अनीता", "पूजा", "प्रिया", "गीता", "सीता"),
}
SYLLABLES = {"LATIN": ("ba", "den", "fol", "gar", "hal", "kim", "lor", "mas", "ner", "pol", "ris", "sen", "tal", "vor", "win", "zel"), "CYRILLIC": ("ба", "ден", "фол", "гар", "ким", "лор", "мас", "нер", "пол", "рис", "сен", "тал", "вор", "зел", "жук", "бор")}
GENDER = {n.lower(): g for (g, _), names in NAMES.items() for n in names}

_given = "|".join(x for names in NAMES.values() for n in names for x in dict.fromkeys((n, n.upper())))
_titles = {t.lower(): g for g, ts in TITLES.items() for t in ts}
#: Letters, with the vowel signs and marks that some scripts write words with.
_letter = r"(?:[^\W\d_]|[\u0300-\u036f\u0591-\u05c7\u064b-\u065f\u0900-\u0903\u093a-\u094f\u0e31-\u0e4e])"
_cap = rf"[^\W\d_a-zß-öø-ÿа-яёα-ώ]{_letter}++"
#: A name of one part or several, as in O'Neill and Smith-Jones.
_name = rf"(?:[^\W\d_a-zß-öø-ÿа-яёα-ώ]['’])?{_cap}(?:[-'’]{_cap})*+"
_title = "|".join(sorted((t for ts in TITLES.values() for t in ts), key=len, reverse=True))
PATTERNS = (
    ("email", re.compile(r"(?<![\w.+%-])[A-Za-z0-9_][A-Za-z0-9._%+-]*+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}(?![A-Za-z0-9-])"), "@"),
    ("ssn", re.compile(r"\d(?<![\d-]\d)\d{2}-\d{2}-\d{4}(?![\d-])"), "-"),
    ("ip", re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d)"), "."),
    ("iban", re.compile(r"[A-Z](?<!\w[A-Z])[A-Z]\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"), ""),
    ("ip6", re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:]|\.\d)"), ":"),
    ("card", re.compile(r"\d(?<![\w.+-]\d)(?:[ -]?\d){12,18}(?![\w-])"), ""),
    ("phone", re.compile(r"[+(\d](?<![\w.].)(?:(?<=\+)\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|(?<=\()\d{3}\) ?\d{3}[ .-]\d{4}|(?<=\d)\d{2}-\d{3}-\d{4}|(?<=\d)\d{2}\.\d{3}\.\d{4}|(?<=0)(?=(?:[ /-]?\d){8,10}(?!\d))\d{1,4}[ /-]\d{3,4}[ -]?\d{3,4})(?![\w-])"), ""),
)
#: What every address of the sixth version holds.
COLONS = re.compile(r":[0-9A-Fa-f]{0,4}:")
NAME = re.compile(rf"(?<![\w-])(?:(?P<title>{_title})(?!\w)\.?[ ]+(?P<one>{_name})(?:[ ]+(?P<two>{_name}))?|(?P<given>(?:{_given})(?:-{_cap})?)[ ]+(?P<last>{_name}))")
MENTION = re.compile(rf"(?<!\w){_name}(?!\w)")
PARTS = re.compile(r"([-'’])")
_heads: dict[str, list[str]] = {}
for _word in f"{_title}|{_given}".split("|"):
    _heads.setdefault(_word[0], []).append(_word[1:])
# Patterns begin with the characters that they may begin with, and look back from there: so the search skips all others.
ANY_NAME = re.compile(rf"[{''.join(_heads)}](?<!\w.)(?:{'|'.join(f'(?<={c})(?:{"|".join(rest)})' for c, rest in _heads.items())})(?!\w)")
CUED = re.compile(rf"(?<!\w)(?i:{'|'.join(map(re.escape, CUES))})\s{{1,4}}(?P<one>{_name})[ ](?P<two>{_name})(?!\w)")
ANY_CUE = re.compile("|".join(re.escape(c[1:]) for c in CUES), re.IGNORECASE)
MAILED = re.compile(rf"(?<!\w)(?P<one>{_name})[ ](?P<two>{_name})[ ]?[<(](?=[A-Za-z0-9._%+-]+@)")


def luhn(digits: str) -> bool:
    two = [int(x) for x in reversed(digits)]
    return (sum(two[0::2]) + sum(sum(divmod(2 * x, 10)) for x in two[1::2])) % 10 == 0


def iban_check(text: str) -> int:
    """The two check digits of an account number, whatever stands in their place."""
    return 98 - int("".join(str(int(c, 36)) for c in text[4:] + text[:2])) * 100 % 97


def address(text: str) -> str | None:
    """An IPv6 address in its shortest form; None if the text is none, or so short that it may be anything else."""
    if not (re.search(r"\d", text) and len(re.findall("[0-9A-Fa-f]+", text)) >= 3):
        return None
    try:
        return ipaddress.IPv6Address(text).compressed
    except ValueError:
        return None


def _valid(kind: str, text: str) -> bool:
    if kind == "card":
        return luhn(re.sub(r"\D", "", text))
    if kind == "iban":
        plain = text.replace(" ", "")
        return 15 <= len(plain) <= 34 and int(plain[2:4]) == iban_check(plain)
    return kind != "ip6" or address(text) is not None


def family(kind: str) -> str:
    """The kind without a gender."""
    return kind.partition(":")[0]


def gender(name: str) -> str:
    """The gender that the list gives a first name (of several parts: the first), n without one."""
    return GENDER.get(name.lower()) or GENDER.get(name.lower().partition("-")[0], "n")


def canonical(kind: str, text: str) -> str:
    if kind in ("card", "phone", "ssn"):
        return re.sub(r"\D", "", text)
    if kind in ("iban", "ip6"):
        return text.replace(" ", "") if kind == "iban" else address(text)
    return text.casefold().replace("’", "'") if len(text.casefold()) == len(text) else text


def detect(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the entities of a text, leftmost first, without overlaps. Names are given:g or last, with g the gender."""
    if not text:
        return []
    found = []
    for kind, pattern, mark in PATTERNS:
        if mark in text and (kind != "ip6" or COLONS.search(text)):
            for m in pattern.finditer(text):
                if _valid(kind, m[0]):
                    found.append((*m.span(), kind))
    named = (CUED,) if ANY_CUE.search(text) else ()
    if "@" in text:
        named += (MAILED,)
    names = []
    for pattern in named:
        for m in pattern.finditer(text):
            names += [(*m.span("one"), f"given:{gender(m['one'])}"), (*m.span("two"), "last")]
    if ANY_NAME.search(text):
        for m in NAME.finditer(text):
            title, one, two, given = m["title"], m["one"], m["two"], m["given"]
            if title:
                said = _titles[title.lower()]
                if two:
                    names += [(*m.span("one"), f"given:{gender(one) if said == 'n' else said}"), (*m.span("two"), "last")]
                else:
                    names.append((*m.span("one"), f"given:{gender(one)}" if gender(one) != "n" else "last"))
            else:
                names += [(*m.span("given"), f"given:{gender(given)}"), (*m.span("last"), "last")]
    if names:  # whatever else mentions them; without a say in the gender
        kinds: dict[str, str] = {}
        for a, b, kind in sorted(names):
            kinds.setdefault(canonical(kind, text[a:b]), "last" if kind == "last" else f"given:{gender(text[a:b])}")
        found += names
        found += [(*m.span(), kind) for m in MENTION.finditer(text) if (kind := kinds.get(canonical("last", m[0])))]
    out, at = [], 0
    for a, b, kind in sorted(found, key=lambda x: (x[0], -x[1])):
        if a >= at:
            out.append((a, b, kind))
            at = b
    return out


def script(text: str) -> str:
    """The script of a text's first letter, as Unicode's names begin: LATIN, GREEK, CJK, …"""
    return next((unicodedata.name(c, "LATIN").split()[0] for c in text if c.isalpha()), "LATIN")


@lru_cache(maxsize=4096)
def _alike(c: str) -> str:
    """Letters of the script and kind (capital, small or neither) of c, from the code points around it (of all ideographs or syllables, where those are many)."""
    at, name, kind = ord(c), unicodedata.name(c, "").split(" ")[0], unicodedata.category(c)
    first, size = (at // 128 * 128, 128) if name not in ("CJK", "HANGUL") else (at // 4096 * 4096, 4096)
    near = map(chr, range(first, first + size))
    return "".join(x for x in near if unicodedata.category(x) == kind and unicodedata.name(x, "").split(" ")[0] == name and len(x.lower()) == len(x.upper()) == 1)


class _Draws:
    """Endless numbers below n, drawn from the key and what they are for."""

    def __init__(self, key: bytes, what: str) -> None:
        self.key, self.what, self.round, self.pool = key, what, 0, b""

    def below(self, n: int) -> int:
        if len(self.pool) < 4:
            self.pool += hmac.digest(self.key, f"{self.what}|{self.round}".encode(), "sha256")
            self.round += 1
        x, self.pool = int.from_bytes(self.pool[:4], "big"), self.pool[4:]
        return x * n >> 32


def _name_part(d: _Draws, kind: str, value: str, attempt: int) -> str:
    s = script(value)
    if kind != "last":
        genders = (kind[-1],) if kind[-1] != "n" else ("m", "f")
        pool = [n.lower() for g in genders for n in NAMES.get((g, s), ()) if n.lower() != value]
        if pool and attempt < 8:
            return pool[d.below(len(pool))]
    if s not in SYLLABLES:
        new = "".join(p[d.below(len(p))] if (p := _alike(c)) else c for c in value)
        letters = [c for c in value if _alike(c)]
        return new + "".join(p[d.below(len(p))] for c in letters[-1:] * (attempt // 8) if (p := _alike(c)))
    # beyond the known names, and for surnames: syllables, more of them with every eight attempts
    stem = "".join(SYLLABLES[s][d.below(len(SYLLABLES[s]))] for _ in range(3 + attempt // 8))
    return stem + {"mLATIN": "o", "fLATIN": "a", "fCYRILLIC": "а"}.get(kind[-1] + s, "")


def surrogate(key: bytes, kind: str, value: str, attempt: int = 0) -> str:
    """The canonical surrogate of a canonical value. It has the form of the value; the same attempt always gives the same."""
    d = _Draws(key, f"{family(kind)}|{value}|{attempt}")
    if family(kind) in ("given", "last"):  # separators stay, and single letters before them
        return "".join(p if len(p) < 2 and len(value) > 1 else _name_part(d, kind, p, attempt) for p in PARTS.split(value))
    if kind == "iban":
        new = value[:2] + "00" + "".join(chr(65 + d.below(26)) if c.isalpha() else str(d.below(10)) for c in value[4:])
        return f"{new[:2]}{iban_check(new):02d}{new[4:]}"
    if kind == "ip6":
        parts = ["".join("123456789abcdef"[d.below(15)] for _ in p) if set(p) != {"0"} else p for p in value.split(":")]
        return ipaddress.IPv6Address(":".join(parts)).compressed
    if kind == "ip":
        return ".".join(str(1 + d.below(254)) for _ in range(4))
    if kind == "phone":
        lead = 1 if len(value) == 11 and value[0] == "1" else max(0, len(value) - 10)  # the country's code stays
        return value[:lead] + "".join(str(d.below(10) if i else 2 + d.below(8)) for i in range(len(value) - lead + attempt // 64))
    if kind in ("card", "ssn"):
        digits = "".join(str(1 + d.below(9)) if not i else str(d.below(10)) for i in range(len(value)))
        return next(digits[:-1] + c for c in "0123456789" if luhn(digits[:-1] + c)) if kind == "card" else digits
    keep = value.rfind(".")  # an address: the last part of the domain stays
    swap = lambda c: chr(97 + d.below(26)) if c.isalpha() else str(d.below(10)) if c.isdigit() else c
    more = "".join(chr(97 + d.below(26)) for _ in range(attempt // 8))
    return more + "".join(swap(c) if i < keep else c for i, c in enumerate(value))


def dressed(kind: str, plain: str, original: str) -> str:
    """The canonical surrogate with the separators and the case of the original."""
    if kind in ("card", "phone", "ssn", "iban"):
        digits = iter(plain)
        return "".join(next(digits) if c.isalnum() else c for c in original) + "".join(digits)
    if kind == "ip6":  # in the notation of the original, if that is the short or the full one
        plain = plain if original.lower() == address(original) else ipaddress.IPv6Address(plain).exploded
        return plain.upper() if original.isupper() else plain
    if kind == "ip":
        return plain
    if kind == "email":
        more = len(plain) - len(original)
        return plain[:more] + "".join(p.upper() if o.isupper() else p for p, o in zip(plain[more:], original, strict=True))
    if original.isupper() and len(original) > 1:
        return plain.upper()
    new, old = PARTS.split(plain), PARTS.split(original)
    return "".join(o if i % 2 else n.capitalize() if o[:1].isupper() else n for i, (n, o) in enumerate(zip(new, old, strict=True)))


#: Draws for one value before a job gives up.
MOST = 1000


def entities(docs: DataFrame, text_col: str) -> DataFrame:
    """(kind, value, form, learned): the distinct canonical entities of all documents. form: the kind, of first names with their gender; learned: it isn't the list's."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            found: Counter = Counter()
            for t in x["text"]:
                found.update((family(k), canonical(k, t[a:b]), k[6:]) for a, b, k in detect(t))
            rows = [(k, v, gender(v) if k == "given" else "", n if g == "m" else 0, n if g == "f" else 0) for (k, v, g), n in sorted(found.items())]
            yield pd.DataFrame(rows, columns=["kind", "value", "known", "m", "f"])

    votes = docs.select(docs[text_col].alias("text")).mapInPandas(run, "kind string, value string, known string, m long, f long")
    x = votes.groupBy("kind", "value").agg(F.max("known").alias("known"), F.sum("m").alias("m"), F.sum("f").alias("f"))
    most = F.when(F.col("m") > F.col("f"), "m").when(F.col("f") > F.col("m"), "f").otherwise("n")
    learned = (F.col("kind") == "given") & (F.col("known") == "n") & (most != "n")
    form = F.when(F.col("kind") == "given", F.concat(F.lit("given:"), F.when(learned, most).otherwise(F.col("known")))).otherwise(F.col("kind"))
    return x.select("kind", "value", form.alias("form"), learned.alias("learned"))


def redraws(found: DataFrame, key: bytes) -> DataFrame:
    """(kind, value, form, attempt) of the entities whose first surrogate is taken by another or occurs as a value itself, and of those whose gender is learned."""
    draw = F.pandas_udf(lambda k, v, a: pd.Series([surrogate(key, *x) for x in zip(k, v, a, strict=True)], dtype="object"), T.StringType())
    state = found.select("kind", "value", "form", "learned", F.lit(0).alias("attempt"))
    state = stash(state.withColumn("plain", draw("form", "value", "attempt")), "surrogates")
    while True:
        real = state.select("kind", F.col("value").alias("plain")).distinct().withColumn("real", F.lit(True))
        # A surrogate goes to the value with the fewest attempts, then the smallest.
        owner = state.groupBy("kind", "plain").agg(F.min(F.struct("attempt", "value")).getField("value").alias("owner"), F.min("value").alias("v0"), F.max("value").alias("v1"))
        bad = owner.join(real, ["kind", "plain"], "left").where("real or v0 <> v1").select("kind", "plain", "owner", F.coalesce("real", F.lit(False)).alias("real"))
        again = state.join(bad, ["kind", "plain"]).where("real or value <> owner").select("kind", "value", "form", "learned", (F.col("attempt") + 1).alias("attempt"))
        again = stash(again, "surrogates", n=F.count(F.lit(1)), most=F.max("attempt"))
        if (again.facts["most"] or 0) > MOST:
            raise ArithmeticError("there are no surrogates left for some values")
        if not again.facts["n"]:
            return state.where("attempt > 0 or learned").select("kind", "value", "form", "attempt")
        rest = state.join(again, ["kind", "value"], "left_anti")
        state = stash(rest.unionByName(again.withColumn("plain", draw("form", "value", "attempt"))), "surrogates")


def replace_entities(docs: DataFrame, key: bytes, text_col: str = "text", id_col: str = "doc_id", redraw_bound: int = 10_000, marks: bool = False) -> DataFrame:
    """docs with the entities in text_col replaced. marks: also n_entities, and entities (kind:start:end in the original text, comma-joined)."""
    found = stash(entities(docs, text_col), "entities")
    odd = stash(redraws(found, key), "redraws")
    few = odd.limit(redraw_bound + 1).count() <= redraw_bound
    sent = {(r.kind, r.value): (r.form, r.attempt) for r in odd.collect()} if few else {}
    column = [f.name for f in docs.schema].index(text_col)
    extra = T.StructType([T.StructField("n", T.LongType()), T.StructField("said", T.StringType()), T.StructField("text", T.StringType())])

    def replaced(text: str | None, own: dict) -> tuple[int, str, str | None]:
        if not (spans := detect(text)):
            return 0, "", text
        out, at = [], 0
        for a, b, kind in spans:
            value = canonical(kind, text[a:b])
            form, attempt = own.get((family(kind), value)) or (f"given:{gender(value)}" if family(kind) == "given" else kind, 0)
            out += [text[at:a], dressed(kind, surrogate(key, form, value, attempt), text[a:b])]
            at = b
        return len(spans), ",".join(f"{k}:{a}:{b}" for a, b, k in spans), "".join(out) + text[at:]

    def plainly(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([replaced(t, sent) for t in texts], columns=["n", "said", "text"])

    def joined(texts: pd.Series, own: pd.Series) -> pd.DataFrame:
        rows = [replaced(t, {(r["kind"], r["value"]): (r["form"], r["attempt"]) for r in (o if o is not None else ())}) for t, o in zip(texts, own, strict=True)]
        return pd.DataFrame(rows, columns=["n", "said", "text"])

    base = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[text_col].alias("text"))
    if few:
        new = F.pandas_udf(plainly, extra)("text")
    else:  # each document with the redraws of its own entities, by a digest of its text
        def held(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for x in batches:
                rows = {(k, family(kind), canonical(kind, t[a:b])) for k, t in zip(x["key"], x["text"], strict=True) for a, b, kind in detect(t)}
                yield pd.DataFrame(sorted(rows), columns=["key", "kind", "value"])

        base = base.withColumn("key", F.sha2("text", 256))
        pairs = base.select("key", "text").where("text is not null").mapInPandas(held, "key string, kind string, value string").distinct()
        own = pairs.join(odd, ["kind", "value"]).groupBy("key").agg(F.collect_list(F.struct("kind", "value", "form", "attempt")).alias("own"))  # of one text
        base = base.join(own, "key", "left")
        new = F.pandas_udf(joined, extra)("text", "own")
    done = base.select("row", new.alias("new"))
    cols = [F.col("new.text").alias(c) if i == column else F.col("row")[c].alias(c) for i, c in enumerate(docs.columns)]
    return done.select(*cols, *([F.col("new.n").alias("n_entities"), F.col("new.said").alias("entities")] if marks else []))
