"""Personal information in free text, found by bootstrapped contextual extraction.

1. Surface candidates: strings shaped like an email address, a long number, a street address or a
   pair of name words, each with the words before and after it.
2. Seeds: email addresses are certain, and their local parts (``given.surname@``) seed names;
   international prefixes and published formats seed phone and identity numbers; a short list of
   street words seeds addresses.
3. A graph of patterns (contexts) and instances (number shapes, name words, street words), with the
   number of times they meet. Scores flow from instances to patterns and back for some rounds, as
   joins and aggregations over the whole corpus.
4. Candidates whose instance or patterns came out with high confidence are mentions, so shapes, names
   and streets that no seed knew are found by the company they keep.

Patterns and words are aggregated before any join. The second scan, for names in lower case, broadcasts
two filters of fixed size and joins what passes them with all learned words.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagework.session import cut_lineage, salted_lookup, spread, spread_lookup

#: Rounds of scoring, and the confidence from which a candidate is a mention.
ROUNDS, ACCEPT = 3, 0.5
#: Bits of the filter before the second scan's joins. More words than that let more candidates through and lose none.
FILTER_BITS, _BUCKET = 2**23, 2**15

#: Street words, as seeds of addresses.
STREETS = {
    "street", "st", "lane", "avenue", "ave", "road", "rd", "drive", "terrace", "row", "close", "way", "square",
    "rue", "boulevard", "bd", "chemin", "impasse", "quai", "allée", "place", "route",
    "straße", "strasse", "str", "weg", "gasse", "allee", "platz", "ring", "ufer", "damm", "markt",
    "calle", "c/", "plaza", "paseo", "avda", "avenida", "camino", "ronda",
}
#: Titles, as seed patterns of names.
TITLES = ("herr", "frau", "mr", "mrs", "ms", "dr", "prof", "mme", "mlle", "monsieur", "madame", "don", "doña", "sr", "sra", "señor", "señora")
#: Lower-case street words that are hardly anything else in running text.
PLAIN_STREETS = r"street|lane|avenue|ave\.?|road|rd\.?"
#: Published formats of identity numbers, and forms of phone numbers that leave no doubt (9: digit, A: letter).
ID_SHAPES = ("999-99-9999", "AA 99 99 99 A", "AA999999A", "9 99 99 99 999 999 99", "99999999-A", "A9999999A", "99 999 999 999")
PHONE_SHAPES = r"^(\(?\+9|00[1-9]|\(999\) 999-9999$|999-999-9999$|999\.999\.9999$|9-999-999-9999$)"
#: Words for digits.
DIGITS = "zero|oh|one|two|three|four|five|six|seven|eight|nine|null|eins|zwei|drei|vier|fünf|sechs|sieben|acht|neun|zéro|un|deux|trois|quatre|cinq|sept|huit|neuf|cero|uno|dos|tres|cuatro|cinco|seis|siete|ocho|nueve"

_AT = r"(?:\s?@\s?|\s?[(\[]\s?(?:at|AT)\s?[)\]]\s?)"
_DOT = r"(?:\.|\s?[(\[]\s?(?:dot|DOT)\s?[)\]]\s?)"
_LABEL = r"[^\W_](?:[\w-]*[^\W_])?"
EMAIL = re.compile(
    rf"(?<![\w.+-])[^\W_](?:[\w.+-]*\w)?(?:{_AT}{_LABEL}(?:{_DOT}{_LABEL})*{_DOT}[^\W\d_]{{2,}}|\s(?:AT|at)\s{_LABEL}(?:\s(?:DOT|dot)\s{_LABEL})*\s(?:DOT|dot)\s[^\W\d_]{{2,}})(?![\w@])"
)
_SPELLED_AT = re.compile(r"[(\[] ?(?:at|AT) ?[)\]]|\sAT\s|\s(?:dot|DOT)\s")
NUMBER = re.compile(r"(?<![\w.,/@-])[(+]{0,2}\d(?:(?:[ \xa0./-]{0,2}|\) ?| ?\(0\) ?)\d){6,17}(?:[ -]?[A-Z])?(?![\w@]|[.,/-]\d)")
CODE = re.compile(r"(?<![\w@./-])(?:[A-Z]{2} ?\d\d ?\d\d ?\d\d ?[A-Z]|(?=[A-Z0-9]*\d)(?=[A-Z0-9]*[A-Z])[A-Z0-9]{8,12})(?![\w@]|-\w)")
SPELLED = re.compile(rf"\b(?:(?:{DIGITS})[ -]){{6,14}}(?:{DIGITS})\b")
EXTENSION = re.compile(r",? ?(?:ext|x|extension|Durchwahl|poste)\.? ?\d{1,5}(?!\w)", re.I)
_U, _L = "A-ZÀ-ÖØ-Þ", "a-zß-öø-ÿ"
_WORD = rf"(?:[{_U}][{_L}]{{0,3}}\.|[{_U}][{_U}{_L}'’-]*str\.|[{_U}][{_U}{_L}'’-]*)"
ADDRESSES = (  # (regex, group of the street word: first or last word of the street, or all of it)
    (re.compile(rf"(?=[FAUS\d])(?:(?:Flat|Apt\.?|Apartment|Unit|Suite) \w{{1,5}}, )?(?<![\w.])\d{{1,4}}[A-Za-z]?,? (?P<s>(?:St\. )?{_WORD}(?: {_WORD}){{0,2}})(?![\w])"), "last"),
    (re.compile(rf"(?<![\w.])\d{{1,4}}[A-Za-z]? (?P<s>(?:st\. )?[{_L}'’]+(?: [{_L}'’]+)? (?:{PLAIN_STREETS}))(?!\w)"), "last"),
    (re.compile(rf"(?<![\w.])\d{{1,4}}[A-Za-z]? (?P<s>(?:st\. )?[{_L}'’]+(?: [{_L}'’]+)? [{_L}]+)(?=, (?:apt|flat|unit|suite)\.? ?\d)"), "last"),
    (re.compile(rf"(?=[AaBbÉéEe\d])(?:(?:[Aa]ppt?\.?|[Bb]ât\.?|[Bb]âtiment|[Aa]ppartement|[ÉéEe]tage|[Ee]sc\.?) ?\w{{1,4}}, )?(?<![\w.])\d{{1,4}}(?: ?(?:bis|ter))?,? (?P<s>[{_L}]+\.? (?:de la |de l['’]|des |du |de |d['’])?{_WORD}(?:[ -]{_WORD}){{0,2}})"), "first"),
    (re.compile(rf"(?<![\w.])(?P<s>(?:C/ ?)?{_WORD}(?: (?:de las|de los|de la|del|de|y) {_WORD}| {_WORD}){{0,3}}(?:,| n\.?[ºo°])?) {{1,2}}\d{{1,4}}(?! ?%)[a-z]?(?!\w)"), "either"),
)
_TRAIL = re.compile(rf"(?:, (?:apt|flat|unit|suite)\.? ?\w{{1,4}}(?!\w))?(?:, \d{{1,2}}\.?[ºª°]? ?[A-Z](?!\w))?(?:(?:, |\n)(?:\d{{5}} )?[{_U}][{_L}]+(?:-[{_U}][{_L}]+| [{_U}][{_L}]+(?=[,.;\n]|$| \d| and ))?(?: \d{{5}})?(?!\w))?")

CAPITAL = re.compile(rf"(?<![\w@])[{_U}](?:[{_U}{_L}]|(?<=\w)['’-](?=[{_U}{_L}]))*(?!\w)")
INITIAL = re.compile(r"\.\s{1,2}(?:(?:de la|del|de|des|du|von|van)\s)?", re.I)
PARTICLES = {"de", "del", "des", "du", "von", "van", "zu", "la", "le", "dela"}
GAP = re.compile(r"(?P<comma>,\s)|\s{1,2}(?:[A-ZÀ-Þ]\.\s{1,2})?(?P<part>(?:(?:de la|de las|del|de|des|du|von|van|zu|la|le)\s)?)", re.I)
PARTICLE = re.compile(r"(?<!\w)(?:de la|de las|del|de|des|du|von|van|zu|la|le)\s$", re.I)
LOWER = re.compile(rf"(?<![\w@.+-])[{_L}]+(?:['’-][{_L}]+)*(?![\w@])")
SIDE = re.compile(r"\w+|[^\w\s]")

_CANDIDATES = "source string, row_id string, start int, end int, kind string, inst string, given string, surname string, left2 string, left1 string, right1 string"


def fold(word: str) -> str:
    """Lower case without accents, spaces, hyphens and apostrophes: the way names enter email addresses."""
    flat = unicodedata.normalize("NFKD", word.replace("ß", "ss")).lower()
    return "".join(c for c in flat if c.isalnum())


def shape_of(text: str) -> str:
    if text[:1].isalpha() and " " in text and text.replace(" ", "").replace("-", "").isalpha():
        return "spelled"
    kept = re.sub(r"[A-Za-z]", "A", text)
    return ("00" + re.sub(r"\d", "9", kept[2:])) if re.match(r"00\d", kept) else re.sub(r"\d", "9", kept)


def _sides(text: str, start: int, end: int) -> tuple[str, str, str]:
    before = [re.sub(r"\d+", "0", w) for w in SIDE.findall(text[max(0, start - 48) : start].lower())]
    after = [re.sub(r"\d+", "0", w) for w in SIDE.findall(text[end : end + 32].lower())]
    if start <= 48 and len(before) < 2:
        before = ["^", *before]
    return " ".join(before[-2:]), before[-1] if before else "^", " ".join(after[:2]) or "$"


def _street(kind: str, street: str) -> str:
    words = street.lower().rstrip(",").split()
    if kind == "last":
        return words[-1].rstrip(".") if len(words) > 1 else "bare " + words[0]
    if kind == "first":
        return words[0].rstrip(".")
    if words[-1] in ("nº", "no", "n.º", "n°", "n.°"):
        words = words[:-1]
    first = "c/" if words[0].startswith("c/") else words[0].rstrip(".")
    if first in STREETS:  # a street has a name besides its kind
        return first if len(words) > 1 or len(words[0]) > len(first) + 1 else "bare " + first
    tail = words[-1].rstrip(".,")
    for seed in sorted(STREETS, key=len, reverse=True):
        if len(seed) > 2 and tail.endswith(seed) and (len(words) > 1 or len(tail) > len(seed)):
            return seed
    return " ".join(words).rstrip(",")


def _words(text: str) -> list[tuple[int, int, str]]:
    """Capitalised words; a particle in capitals and the word after it are one."""
    words: list[tuple[int, int, str]] = []
    for m in CAPITAL.finditer(text):
        if words and words[-1][2].lower() in PARTICLES and text[words[-1][1] : m.start()] in (" ", "  "):
            words[-1] = (words[-1][0], m.end(), words[-1][2] + m.group())
        else:
            words.append((*m.span(), m.group()))
    return words


def _names(text: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, form, given, surname) of neighbouring capitalised words; given is '.' for an initial.
    Forms: ``ab`` (given name first), ``ba`` (surname, comma, given name)."""
    words = _words(text)
    for i, (at, to, word) in enumerate(words):
        for before in words[max(0, i - 2) : i]:
            gap = text[before[1] : at]
            if len(gap) > 14 or len(word) < 2:
                continue
            if len(before[2]) == 1 and INITIAL.fullmatch(gap):
                yield before[0], to, "ab", ".", fold(word)
            g = GAP.fullmatch(gap) if len(before[2]) > 1 else None
            if g and g["comma"]:
                p = PARTICLE.search(text[max(0, before[0] - 8) : before[0]])
                yield before[0] - (len(p.group()) if p else 0), to, "ba", fold(word), fold((p.group() if p else "") + before[2])
            elif g:
                yield before[0], to, "ab", fold(before[2]), fold((g["part"] or "") + word)


def _owner(local: str) -> tuple[str, str, str]:
    """(form, given, surname) that the local part of an address speaks of: ``given.surname`` is ``sure``; the surname
    in ``surname12``, ``surname-g`` and ``gsurname`` is ``likely``."""
    parts = re.split(r"[._]", local)
    if len(parts) == 2 and all(len(p) > 1 and p.isalpha() for p in parts):
        return "sure", fold(parts[0]), fold(parts[1])
    m = re.fullmatch(r"([^\W\d_]{3,})(?:\d+|-[^\W\d_])", local)
    if m:
        return "likely", "", fold(m[1])
    return ("likely", "", fold(local[1:])) if len(local) > 4 and local.isalpha() else ("", "", "")


def _candidates_of(text: str) -> Iterator[tuple]:
    taken: list[tuple[int, int]] = []
    for m in EMAIL.finditer(text) if "@" in text or _SPELLED_AT.search(text) else ():
        taken.append(m.span())
        local = re.split(r"[+@(\[ ]", m.group(), maxsplit=1)[0]
        yield m.start(), m.end(), "email", *_owner(local)
    low = text.lower()
    for pattern in (NUMBER, CODE, SPELLED):
        for m in pattern.finditer(low if pattern is SPELLED and len(low) == len(text) else text):
            start, end = m.span()
            if any(a < end and start < b for a, b in taken):
                continue
            inst = shape_of(m.group())
            more = EXTENSION.match(text, end)
            taken.append((start, more.end() if more else end))
            yield start, taken[-1][1], "number", inst, "", ""
    for pattern, kind in ADDRESSES:
        for m in pattern.finditer(text):
            start, end = m.span()
            if any(a < end and start < b for a, b in taken):
                continue
            street = _street(kind, m["s"])
            more = _TRAIL.match(text, end)
            yield start, more.end() if more else end, "address", street, "", ""
    for start, end, form, given, surname in _names(text):
        yield start, end, "name", form, given, surname


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in _CANDIDATES.split(", ")]
    for batch in batches:
        out = []
        for source, rid, text in zip(batch["source"], batch["row_id"], batch["text"], strict=True):
            for start, end, kind, inst, given, surname in _candidates_of(text):
                while start < end and not text[start].isalnum():
                    start += 1
                out.append((source, rid, start, end, kind, inst, given, surname, *_sides(text, start, end)))
            if len(out) > 50_000:
                yield pd.DataFrame(out, columns=names)
                out = []
        yield pd.DataFrame(out, columns=names)


def texts_of(df: DataFrame, source: str, text_col: str, id_col: str = "id") -> DataFrame:
    """source, row_id, text: the non-empty texts of one column."""
    return df.select(F.lit(source).alias("source"), F.col(id_col).cast("string").alias("row_id"), F.col(text_col).alias("text")).where("row_id is not null and text != ''")


def _either(*scores: Column) -> Column:
    """Noisy or."""
    rest = F.lit(1.0)
    for s in scores:
        rest = rest * (F.lit(1.0) - F.coalesce(s, F.lit(0.0)))
    return F.lit(1.0) - rest


def _patterns(df: DataFrame) -> DataFrame:
    """Each candidate once per pattern around it."""
    sides = F.array(F.concat(F.lit("<<"), "left2"), F.concat(F.lit("<"), "left1"), F.concat(F.lit(">"), "right1"))
    return df.withColumn("pattern", F.explode(sides))


def _score_shapes(found: DataFrame, kind: str, seeds: Column, types: list[str]) -> tuple[DataFrame, DataFrame]:
    """Confidence of every instance and pattern of one kind for each of its types: (inst, c_*), (pattern, p_*)."""
    edges = cut_lineage(_patterns(found.where(F.col("kind") == kind)).where("pattern not like '<<^%' and pattern not like '>$%'").groupBy("inst", "pattern").agg(F.count("*").alias("n")))
    seeded = edges.select("inst").distinct().withColumn("seed", seeds)
    insts = seeded.select("inst", "seed", *(F.when(F.col("seed") == t, 1.0).otherwise(0.0).alias(f"c_{t}") for t in types))
    patterns = None
    for _ in range(ROUNDS):
        # an unknown instance counts against a pattern, so loose contexts stay weak
        patterns = edges.join(insts, "inst").groupBy("pattern").agg(*((F.sum(F.col("n") * F.col(f"c_{t}")) / (F.sum("n") + 1)).alias(f"p_{t}") for t in types))
        back = edges.join(patterns, "pattern").groupBy("inst").agg(*((F.sum(F.col("n") * F.col(f"p_{t}")) / F.sum("n")).alias(f"b_{t}") for t in types))
        insts = cut_lineage(
            insts.select("inst", "seed").join(back, "inst", "left").select("inst", "seed", *(F.when(F.col("seed").isNotNull(), (F.col("seed") == t).cast("double")).otherwise(F.coalesce(f"b_{t}", F.lit(0.0))).alias(f"c_{t}") for t in types))
        )
    return insts.drop("seed"), cut_lineage(patterns)


def _typed(found: DataFrame, kind: str, insts: DataFrame, patterns: DataFrame, types: list[str]) -> DataFrame:
    """Mentions of one kind: the type whose instance and patterns agree best."""
    sides = (("left2", "<<"), ("left1", "<"), ("right1", ">"))
    own = found.where(F.col("kind") == kind).withColumns({f"__{side}": F.concat(F.lit(mark), side) for side, mark in sides})
    # a shape or context that much of the corpus shares, as a comma, is spread over many tasks
    mine = spread_lookup(own, insts, "inst", "start")
    for side, _ in sides:
        named = patterns.select(F.col("pattern").alias(f"__{side}"), *(F.col(f"p_{t}").alias(f"{side}_{t}") for t in types))
        mine = spread_lookup(mine, named, f"__{side}", "start", counted=own)
    # the instance and at least a hint of a context must agree; a sure instance stands alone
    context = {t: _either(F.col(f"left2_{t}"), F.col(f"left1_{t}") * 0.5, F.col(f"right1_{t}") * 0.5) for t in types}
    scores = [F.struct(_either(F.col(f"c_{t}"), context[t] * F.least(F.lit(1.0), F.col(f"c_{t}") * 2 + 0.35)).alias("score"), F.lit(t).alias("type")) for t in types]
    best = F.array_max(F.array(*scores))
    return mine.withColumn("best", best).where(F.col("best.score") >= ACCEPT).select("source", "row_id", "start", "end", F.col("best.type").alias("pii_type"), F.col("best.score").alias("score"))


def _score_names(found: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Candidates of names with their confidence; the words that are given names and surnames; the patterns."""
    pairs = found.where("kind = 'name'")
    seeds = cut_lineage(found.where("kind = 'email' and inst != ''").groupBy("given", "surname", "inst").agg(F.count("*").alias("n")))
    given = seeds.where("given != ''").groupBy("given").agg(F.lit(0.9).alias("g"))
    surname = seeds.groupBy("surname").agg(F.max(F.when(F.col("inst") == "sure", 0.9).otherwise(0.6)).alias("s"))
    titled = F.substring_index(F.regexp_replace("pattern", r"^<<| \.$", ""), " ", -1).isin(*TITLES)
    edges = cut_lineage(_patterns(pairs).where("pattern like '<<%'").groupBy("given", "surname", "pattern").agg(F.count("*").alias("n")))
    # only "given surname" teaches words: what comes before a comma may be anything ("Signed, Ada ...")
    counts = cut_lineage(pairs.groupBy("given", "surname").agg(F.count("*").alias("n"), F.count_if(F.col("inst") == "ab").alias("ab")))
    patterns = None
    for _ in range(ROUNDS):
        known = counts.join(given, "given", "left").join(surname, "surname", "left")
        g, s = F.coalesce("g", F.lit(0.0)), F.coalesce("s", F.lit(0.0))
        seeded = cut_lineage(known.select("given", "surname", "n", "ab", g.alias("g"), s.alias("s"), F.when(F.col("given") == ".", s).otherwise(F.least(g, s)).alias("word")))
        patterns = cut_lineage(edges.join(seeded.select("given", "surname", "word"), ["given", "surname"]).groupBy("pattern").agg((F.sum(F.col("n") * F.col("word")) / (F.sum("n") + 2)).alias("p")).withColumn("p", F.when(titled, F.greatest("p", F.lit(0.8))).otherwise(F.col("p"))))
        context = edges.join(patterns, "pattern").groupBy("given", "surname").agg((F.sum(F.col("n") * F.col("p")) / F.sum("n")).alias("ctx"))
        scored = cut_lineage(seeded.join(context, ["given", "surname"], "left").withColumn("ctx", F.coalesce("ctx", F.lit(0.0))).where("ab > 0"))
        # a word is a surname in so far as given names, or contexts of names, lead to it; and the other way round
        new_given = scored.where("given != '.'").groupBy("given").agg((F.sum(F.col("ab") * F.greatest("s", "ctx")) / (F.sum("ab") + 0.3)).alias("new"))
        new_surname = scored.groupBy("surname").agg((F.sum(F.col("ab") * F.greatest(F.when(F.col("given") != ".", F.col("g")).otherwise(0.0), "ctx")) / (F.sum("ab") + 0.3)).alias("new"))
        given = cut_lineage(given.join(new_given, "given", "full").select("given", F.greatest(F.coalesce("new", F.lit(0.0)), F.coalesce("g", F.lit(0.0))).alias("g")))
        surname = cut_lineage(surname.join(new_surname, "surname", "full").select("surname", F.greatest(F.coalesce("new", F.lit(0.0)), F.coalesce("s", F.lit(0.0))).alias("s")))
    return pairs, given, surname, patterns


def _name_mentions(pairs: DataFrame, given: DataFrame, surname: DataFrame, patterns: DataFrame) -> DataFrame:
    own = pairs.withColumn("pattern", F.concat(F.lit("<<"), "left2"))
    mine = own
    for table, key in ((given, "given"), (surname, "surname"), (patterns.where(F.col("pattern").startswith("<<")).withColumnRenamed("p", "pl"), "pattern")):
        mine = spread_lookup(mine, table, key, "start", counted=own)
    g, s = F.coalesce("g", F.lit(0.0)), F.coalesce("s", F.lit(0.0))
    word = F.when(F.col("given") == ".", s).otherwise(F.least(g, s))
    # strong words, or a strong context and no word known to be something else
    score = F.greatest(word, F.coalesce("pl", F.lit(0.0)) * F.when(F.greatest(g, s) >= 0.3, 1.0).otherwise(0.75)) - F.when(F.col("inst") == "ba", 0.2).otherwise(0.0)
    fits = F.col("score") >= F.lit(ACCEPT) - F.when(F.col("inst") == "ba", 0.2).otherwise(0.0)
    return mine.withColumn("score", score).where(fits).select("source", "row_id", "start", "end", F.lit("name").alias("pii_type"), "score")


def _bitmap(words: DataFrame, col: str) -> bytes:
    """A bit for each word's CRC. It is of fixed size, whatever the corpus; other words may share a bit."""
    at = F.pmod(F.crc32(F.col(col).cast("binary")), F.lit(FILTER_BITS))
    parts = words.groupBy(F.floor(at / _BUCKET).cast("int").alias("bucket")).agg(F.expr(f"bitmap_construct_agg(pmod(crc32(cast({col} AS binary)), {_BUCKET}L))").alias("bits"))
    bits = bytearray(FILTER_BITS // 8)
    for r in parts.toLocalIterator():
        bits[r["bucket"] * _BUCKET // 8 : (r["bucket"] + 1) * _BUCKET // 8] = r["bits"]
    return bytes(bits)


def _find_lower(filters: object):
    """Second scan: words in lower case that may be names by the filters. asks says what decides: 0 the given name and
    1 the surname must be known, 2 is a further given name in front; if 3, or 4 and 5, are known, another form holds."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        given_bits, surname_bits = filters.value
        particle = {"de", "la", "las", "del", "des", "du", "von", "van", "zu"}
        seen: dict[str, tuple[bool, bool]] = {}

        def maybe(word: str) -> tuple[bool, bool]:
            if (hit := seen.get(word)) is None:
                if len(seen) > 200_000:
                    seen.clear()
                at = zlib.crc32(word.encode()) % FILTER_BITS
                hit = seen[word] = (bool(given_bits[at >> 3] >> (at & 7) & 1), bool(surname_bits[at >> 3] >> (at & 7) & 1))
            return hit

        for batch in batches:
            out = []
            for source, rid, text in zip(batch["source"], batch["row_id"], batch["text"], strict=True):
                last = []
                for m in LOWER.finditer(text):
                    word = fold(m.group()) if not m.group().isascii() or "-" in m.group() else m.group()
                    may_given, may_surname = maybe(word)
                    if last and m.start() - last[-1][1] > 5:
                        last = []
                    if last:
                        start, end, before, before_given, before_surname = last[-1]
                        gap = text[end : m.start()]
                        comma, near = "," in gap, gap.strip() in ("", ",")
                        if may_surname and near and not comma and before_given:
                            lead = last[-2] if len(last) > 1 and last[-2][3] and last[-2][1] + 1 == start else None
                            out.append((source, rid, start, m.end(), lead[0] if lead else None, [f"g:{before}", f"s:{word}", f"g:{lead[2]}" if lead else None, None, None, None]))
                        if may_given and comma and before_surname:
                            out.append((source, rid, start, m.end(), None, [f"g:{word}", f"s:{before}", None, f"s:{word}" if near else None, None, None]))
                        if len(last) > 1 and before in particle:
                            k = len(last) - 1
                            while k and last[k][2] in particle:
                                k -= 1
                            whole = "".join(x[2] for x in last[k + 1 :]) + word
                            if last[k][3] and maybe(whole)[1]:
                                out.append((source, rid, last[k][0], m.end(), None, [f"g:{last[k][2]}", f"s:{whole}", None, f"s:{word}" if near else None, *((f"g:{word}", f"s:{before}") if comma else (None, None))]))
                    last = [*last[-4:], (m.start(), m.end(), word, may_given, may_surname)]
            yield pd.DataFrame(out, columns=["source", "row_id", "start", "end", "lead", "asks"]).astype({"lead": "Int32"})

    return find


def _lower_mentions(texts: DataFrame, given: DataFrame, surname: DataFrame) -> DataFrame:
    """Names in lower case, of all words that were learned. The filters only spare most other words the joins."""
    given, surname = given.where("g >= 0.6").select("given"), surname.where("s >= 0.6").select("surname")
    filters = texts.sparkSession.sparkContext.broadcast((_bitmap(given, "given"), _bitmap(surname, "surname")))
    some = texts.mapInPandas(_find_lower(filters), "source string, row_id string, start int, end int, lead int, asks array<string>")
    known = given.select(F.concat(F.lit("g:"), "given").alias("ask")).unionByName(surname.select(F.concat(F.lit("s:"), "surname").alias("ask"))).withColumn("known", F.lit(True))
    asked = some.select("source", "row_id", "start", "end", "lead", F.col("asks")[0].alias("first"), F.posexplode("asks").alias("no", "ask")).where("ask is not null")
    form = salted_lookup(asked, known, "ask", "row_id").where("known").groupBy("source", "row_id", "start", "end", "lead", "first").agg(F.collect_set("no").alias("has"))
    has = lambda no: F.array_contains("has", no)
    sure = form.where(has(0) & has(1) & ~has(3) & ~(has(4) & has(5)))
    return sure.select("source", "row_id", F.when(has(2), F.col("lead")).otherwise(F.col("start")).alias("start"), "end", F.lit("name").alias("pii_type"), F.lit(0.9).alias("score"))


def find_mentions(texts: DataFrame) -> DataFrame:
    """Mentions of personal data in ``texts`` (source, row_id, text): source, row_id, start, end, pii_type.

    start is the position, in code points, of the first letter or digit; end is behind the last sign.
    Types: email, phone, id_number, address, name. Overlapping candidates: the surer one holds, then the longer.
    Repeated rows count once; null and empty texts have no mentions. Without any email address names are found
    only by patterns of other kinds' seeds, that is, hardly; no texts give no rows.
    """
    texts = spread(texts, "row_id", "text")
    found = cut_lineage(texts.mapInPandas(_scan, _CANDIDATES).distinct())
    number_seed = F.when(F.col("inst").rlike(PHONE_SHAPES), "phone").when(F.col("inst").isin(*ID_SHAPES), "id_number").when(F.col("inst") == "spelled", "phone")
    # mentions are few beside the text; written one kind after another, so that no plan holds all joins at once
    numbers = cut_lineage(_typed(found, "number", *_score_shapes(found, "number", number_seed, ["phone", "id_number"]), ["phone", "id_number"]))
    addresses = cut_lineage(_typed(found, "address", *_score_shapes(found, "address", F.when(F.col("inst").isin(*sorted(STREETS)), "address"), ["address"]), ["address"]))
    emails = found.where("kind = 'email'").select("source", "row_id", "start", "end", F.lit("email").alias("pii_type"), F.lit(1.0).alias("score"))
    pairs, given, surname, patterns = _score_names(found)
    names = cut_lineage(_name_mentions(pairs, given, surname, patterns))
    lower = _lower_mentions(texts, given, surname)
    every = emails.unionByName(numbers).unionByName(addresses).unionByName(names).unionByName(lower.distinct())
    rank = F.element_at(F.create_map(*(x for i, t in enumerate(["email", "id_number", "phone", "address", "name"]) for x in (F.lit(t), F.lit(5 - i)))), F.col("pii_type"))
    spans = every.groupBy("source", "row_id").agg(F.collect_set(F.struct((-rank).alias("rank"), (-F.round("score", 3)).alias("score"), (F.col("start") - F.col("end")).alias("shorter"), "start", "end", "pii_type")).alias("spans"))
    return spans.mapInPandas(_settle, "source string, row_id string, start int, end int, pii_type string")


def _settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Keeps, of overlapping spans of one text, the first by kind, score and length; joins a further given name."""
    for batch in batches:
        out = []
        for source, rid, spans in zip(batch["source"], batch["row_id"], batch["spans"], strict=True):
            kept: list[list] = []
            for s in sorted((x["rank"], x["score"], x["shorter"], x["start"], x["end"], x["pii_type"]) for x in spans):
                over = [k for k in kept if k[0] < s[4] and s[3] < k[1]]
                if not over:
                    kept.append([s[3], s[4], s[5]])
                elif s[5] == "name" and len(over) == 1 and over[0][2] == "name" and -s[1] >= ACCEPT:
                    over[0][:2] = min(s[3], over[0][0]), max(s[4], over[0][1])  # two given names in front of a surname
            out += [(source, rid, *k) for k in kept]
        yield pd.DataFrame(out, columns=["source", "row_id", "start", "end", "pii_type"])


def redact(texts: DataFrame, mentions: DataFrame) -> DataFrame:
    """source, row_id, redacted: every text with its mentions replaced by ``[TYPE]``; all other text is unchanged.
    Texts without mentions come out as they are. One row per row of ``texts``."""
    spans = mentions.groupBy("source", "row_id").agg(F.array_sort(F.collect_set(F.struct("start", "end", "pii_type"))).alias("spans"))

    def replace(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, marks in zip(batch["text"], batch["spans"], strict=True):
                if marks is None:
                    out.append(text)
                    continue
                parts, at = [], 0
                for m in marks:
                    parts += [text[at : m["start"]], f"[{m['pii_type'].upper()}]"]
                    at = m["end"]
                out.append("".join([*parts, text[at:]]))
            yield batch[["source", "row_id"]].assign(redacted=out)

    return texts.join(spans, ["source", "row_id"], "left").mapInPandas(replace, "source string, row_id string, redacted string")
