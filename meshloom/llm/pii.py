"""9. Personal data: four base kinds, and identifiers found by bootstrapped contexts.

Base kinds are regular expressions with checks. The method then looks at lexical contexts of two forms:

* ``name = value``, ``name: value`` or ``name := value``, with any number of blanks and either side in quotes or not: the
  name and its sign are a pattern, the value an instance;
* prose: what has a digit, or is a base span or well-known secret, is an instance; the two and the three words before it,
  and the two before with the one after it, are its patterns (``employee number is _``).

Seeds are values that a base kind or a well-known secret format recognises. Patterns and instances are the two sides of a
graph that Spark scores in rounds:

* a pattern's confidence is the mean score of its distinct instances (with one more that scores 0);
* a seed scores 1; another instance scores by how confident the *other* patterns are in which it occurs, so a pattern
  never vouches for itself.

Patterns of high confidence, with enough instances and seeds, add all their values: identifiers that no format describes.
Words of prose say less than names, so their patterns need more confidence and seeds, and seeds mostly of one kind: words
that stand before data of all kinds by chance are no context. Values in a well-known secret format are added wherever they stand.

Names and values are taken whole, of whatever length; words of prose that are no context (longer than WORD characters) end it.

Defined cases: null texts are empty and have nothing; rows that share a doc_id are searched each; repeated rows repeat
their result; an empty table gives an empty result; other columns are ignored. Places are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, met, table, text_hash, text_only

KINDS = ("email", "ip", "card", "phone", "secret")
SECRET = len(KINDS)
ROUNDS = 3
LEAST_CONFIDENCE = 0.7
LEAST_INSTANCES = 5
LEAST_SEEDS = 3
#: The same of patterns of prose, and the share of one kind among their seeds.
LEAST_PROSE = {"confidence": 0.85, "instances": 10, "seeds": 8, "share": 0.8}
#: A pattern speaks for an instance only from here on.
SPEAKS = 0.5

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# possessive: a run that fails is not tried again from within
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NAMED = re.compile(r":=|[=:]")
_NAME_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-")
#: A longer name is a pattern by its digest.
LONG_NAME = 64
_DIGIT = re.compile("[0-9]")
WORD = 24
_WORD_BEFORE = re.compile(r"(?<![\w-])[^\W\d_]{1,24}\Z")
_WORD_AFTER = re.compile(r"[\"'`)\]]?[\x20\t\n]+([^\W\d_]{1,24})(?![\w-])")
_BEFORE = re.compile(r"[\x20\t]*+[\"'`]?")
_RUN = re.compile(r"[^\s\"'`,;]*+")
_NOT_BLANK = re.compile(r"\S*+")
#: Characters of a value from which on its hash is built from the right, once for all values that end together.
LONG = 256
_SECRET = re.compile(r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,}+|xox[abp]-[A-Za-z0-9-]{20,}+)(?![A-Za-z0-9])")
_HEX = re.compile(r"[0-9a-f]{16,}+\Z", re.I)
_HEX_TAIL = re.compile(r"[0-9a-f]*+", re.I)

_SPAN = "struct<kind:string,start:long,end:long>"
_FOUND = "struct<pattern:string,instance:long,kind:int,start:long,end:long>"
SCANNED = f"doc_id long, text_hash long, base array<{_SPAN}>, found array<{_FOUND}>"


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    low, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            low = m.end()
        at = text.find("@", max(at + 1, low))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end), ordered by start, then kind."""
    out = [("email", s, e) for s, e in _emails(text)]
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m[0].split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def _suffix_hash(text: str, ends: dict[int, tuple[int, int]], start: int, end: int) -> int:
    """Hash of text[start:end]. The starts of one end come from the right, and ``ends`` keeps how far its hash has come."""
    at, h = ends.get(end, (end, 0))
    for k in range(at - 1, start - 1, -1):
        h = (h * 1_000_003 + ord(text[k]) + 1) % ((1 << 61) - 1)
    ends[end] = (start, h)
    return h


def _digest(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _is_hex(word: str) -> bool:
    return bool(_HEX.match(word)) and not word.isdigit() and not word.isalpha()


def _name_before(text: str, end: int) -> str | None:
    """The name that ends at ``end``: from a letter or _ on, two characters at least."""
    start = end
    while start and text[start - 1] in _NAME_CHARS:
        start -= 1
    while start < end and not (text[start].isalpha() or text[start] == "_"):
        start += 1
    if end - start < 2:
        return None
    name = text[start:end].lower()
    return name if len(name) <= LONG_NAME else f"#{_digest(name):x}"


def named_values(text: str, seeds: dict[tuple[int, int], int], starts: dict[int, int]) -> list[tuple[str | None, int, int, int, int]]:
    """(pattern, instance, kind of seed or 0, start, end) of each named value. ``seeds`` are kinds by place, ``starts`` those of base spans by start."""
    named, high, stripped = [], -1, -1
    for m in _NAMED.finditer(text):
        sign = m.start()
        while sign and text[sign - 1] in " \t":
            sign -= 1
        if sign and text[sign - 1] in "\"'`":  # a quoted name, as in JSON
            sign -= 1
        name, start = _name_before(text, sign), _BEFORE.match(text, m.end()).end()
        if name:
            if start >= high:  # values of one run of characters end together
                high = stripped = _RUN.match(text, start).end()
                while stripped > start and text[stripped - 1] in ".!?)]}>":
                    stripped -= 1
            if stripped - start >= 4:
                named.append((name + m[0], start, stripped))
    ends: dict[int, tuple[int, int]] = {}
    out = []
    for pattern, start, end in reversed(named):
        kind = seeds.get((start, end)) or starts.get(start, 0)
        if end - start > LONG:  # values that end together share the work of their hashes
            instance = _suffix_hash(text, ends, start, end)
            kind = kind or (SECRET if _HEX_TAIL.match(text, start).end() >= end and _is_hex(text[start:end]) else 0)
        else:
            word = text[start:end]
            instance = _digest(word)
            kind = kind or (SECRET if _is_hex(word) else 0)
        out.append((pattern, instance, kind, start, end))
    return out


def words_before(text: str, at: int) -> list[str]:
    """Up to three words that stand before ``at``, the last one first, with any number of blanks behind each."""
    out: list[str] = []
    if at and text[at - 1] in "\"'`([":
        at -= 1
    while len(out) < 3:
        end = at
        while end and text[end - 1] in " \t\n":
            end -= 1
        word = _WORD_BEFORE.search(text, max(0, end - WORD), end) if end < at else None
        if word is None:
            break
        out.append(word[0].lower())
        at = word.start()
    return out


def prose_values(text: str, seeds: dict[tuple[int, int], int]) -> list[tuple[str | None, int, int, int, int]]:
    """The same of values that words of prose stand before: seeds, and what has a digit."""
    spots, at, low = sorted(seeds), 0, 0
    values = []
    for start, end in [*spots, (len(text), len(text))]:
        # runs with a digit between the last seed and this one
        while (m := _DIGIT.search(text, at, start)) is not None:
            a = m.start()
            while a > low and not text[a - 1].isspace():
                a -= 1
            b = min(_NOT_BLANK.match(text, m.end()).end(), start)
            at = low = b
            while a < b and text[a] in "\"'`([{<,;:":
                a += 1
            while a < b and text[b - 1] in "\"'`)]}>,;:.!?":
                b -= 1
            if b - a >= 4:
                values.append((a, b, 0))
        if start < len(text) and start >= at:
            values.append((start, end, seeds[start, end]))
            at = low = end
    out = []
    for a, b, kind in values:
        words = words_before(text, a)
        if len(words) < 2:
            continue
        first, second, third = (*words, None)[:3]
        after = _WORD_AFTER.match(text, b)
        word = text[a:b]
        instance, kind = _digest(word), kind or (SECRET if _is_hex(word) else 0)
        out.append((f"{second} {first} _", instance, kind, a, b))
        if third:
            out.append((f"{third} {second} {first} _", instance, kind, a, b))
        if after:
            out.append((f"{second} {first} _ {after[1].lower()}", instance, kind, a, b))
    return out


def found_values(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str | None, int, int, int, int]]:
    """All instances of ``text``; those with no pattern are well-known secrets."""
    secrets = [(m.start(), m.end()) for m in _SECRET.finditer(text)]
    seeds = {(s, e): KINDS.index(k) + 1 for k, s, e in base}
    starts = {s: KINDS.index(k) + 1 for k, s, _ in base}
    seeds |= {place: SECRET for place in secrets}
    return [(None, 0, SECRET, s, e) for s, e in secrets] + named_values(text, seeds, starts) + prose_values(text, seeds)


def _structs(rows: list[list[tuple]], names: list[str], types: list[pa.DataType]) -> pa.ListArray:
    flat = [r for row in rows for r in row]
    offsets = [0]
    for row in rows:
        offsets.append(offsets[-1] + len(row))
    columns = [pa.array([r[k] for r in flat], t) for k, t in enumerate(types)]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(columns, names))


def scan(docs: DataFrame) -> DataFrame:
    """Base spans and instances of each row."""
    rows = text_only(docs).withColumn("text_hash", text_hash(F.col("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                base, found = [], []
                for text in part.column("text"):
                    text = text.as_py()
                    base.append(base_spans(text))
                    found.append(found_values(text, base[-1]))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text_hash"), _structs(base, ["kind", "start", "end"], [pa.string(), pa.int64(), pa.int64()]), _structs(found, ["pattern", "instance", "kind", "start", "end"], [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64()])],
                    names=["doc_id", "text_hash", "base", "found"],
                )

    return rows.select("doc_id", "text_hash", "text").mapInArrow(run, SCANNED)


def score_patterns(scanned: DataFrame) -> DataFrame:
    """pattern, instances, seeds, confidence and share (of the most frequent kind among the seeds) of each lexical pattern with a seed."""
    named = scanned.select(F.explode("found").alias("f")).select("f.*").filter("pattern is not null")
    edges = named.groupBy("pattern", "instance").agg(F.max("kind").alias("kind"))
    # a pattern without seeds is never trusted and speaks for nothing
    seeded = edges.groupBy("pattern").agg(F.count(F.when(F.col("kind") > 0, 1)).alias("seeds")).filter(f"seeds >= {LEAST_SEEDS}").select("pattern")
    edges = materialise(edges.join(seeded, "pattern", "left_semi"), "edges")
    shares = F.greatest(*(F.count(F.when(F.col("kind") == k + 1, 1)) for k in range(len(KINDS))))

    def confidence(scores: DataFrame) -> DataFrame:
        seeds = F.count(F.when(F.col("kind") > 0, 1))
        return materialise(scores.groupBy("pattern").agg(F.count("*").alias("instances"), seeds.alias("seeds"), (shares / seeds).alias("share"), (F.sum("score") / (F.count("*") + 1)).alias("confidence")), "patterns")

    doubt = F.when(F.col("confidence") >= SPEAKS, F.log(1 - F.least("confidence", F.lit(0.999)))).otherwise(0.0)
    patterns = confidence(edges.withColumn("score", (F.col("kind") > 0).cast("double")))
    for _ in range(ROUNDS - 1):
        told = materialise(edges.join(patterns.select("pattern", doubt.alias("doubt")), "pattern"), "told")
        all_doubt = told.groupBy("instance").agg(F.sum("doubt").alias("all_doubt"))
        others = F.when(F.col("kind") > 0, 1.0).otherwise(1 - F.exp(F.least(F.col("all_doubt") - F.col("doubt"), F.lit(0.0))))
        patterns = confidence(told.join(all_doubt, "instance").withColumn("score", others))
    return patterns


def trusted_patterns(patterns: DataFrame) -> DataFrame:
    """pattern of those whose values are all added."""
    by_name = (F.col("confidence") >= LEAST_CONFIDENCE) & (F.col("instances") >= LEAST_INSTANCES) & (F.col("seeds") >= LEAST_SEEDS)
    in_prose = reduce(Column.__and__, (F.col(c) >= least for c, least in LEAST_PROSE.items()))
    return patterns.filter(F.when(F.contains("pattern", F.lit(" ")), in_prose).otherwise(by_name)).select("pattern")


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, base (the base spans) and spans (all) of each row of ``docs``, arrays of (kind, start, end)."""
    scanned = materialise(scan(docs), "scanned")
    trusted = trusted_patterns(score_patterns(scanned)).withColumn("trusted", F.lit(True))
    # only rows with named values take part; equal rows have equal spans
    named = scanned.filter(F.size("found") > 0).dropDuplicates(["doc_id", "text_hash"]).select("doc_id", "text_hash", F.explode("found").alias("f"))
    added = named.select("doc_id", "text_hash", "f.*").join(trusted, "pattern", "left").filter("pattern is null or trusted")
    spans = added.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct(F.lit("secret").alias("kind"), "start", "end")).alias("more"))
    plain = scanned.filter(F.size("found") == 0).select("doc_id", "text_hash", "base", F.lit(None).cast(f"array<{_SPAN}>").alias("more"))
    some, here = scanned.filter(F.size("found") > 0).alias("s"), spans.alias("m")
    met = some.join(here, F.col("s.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("s.text_hash") == F.col("m.text_hash")), "left").select("s.doc_id", "s.text_hash", "s.base", "m.more")
    out = plain.unionByName(met)
    # an added span that meets a base one gives way to it
    free = F.filter(F.coalesce("more", F.array().cast(f"array<{_SPAN}>")), lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    rank = lambda k: F.array_position(F.array(*map(F.lit, KINDS)), k)
    order = lambda a, b: F.when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1)).otherwise(F.signum(rank(a["kind"]) - rank(b["kind"])).cast("int"))
    return out.select("doc_id", "text_hash", "base", F.array_sort(F.concat("base", free), order).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of its texts replaced by its kind in brackets; ``n_chars``, where there is one, follows the text."""
    spans = find_pii(docs).filter(F.size("spans") > 0).select("doc_id", F.col("text_hash").alias("row_hash"), "spans").dropDuplicates(["doc_id", "row_hash"])
    text = F.col("row.text")
    # overlapping spans are one; the pieces between them and their labels make the new text
    merged = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("parts")),
        lambda acc, s: F.when(s["start"] < acc["at"], F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["parts"].alias("parts"))).otherwise(
            F.struct(s["end"].alias("at"), F.concat(acc["parts"], F.array(F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))).alias("parts"))
        ),
        lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(text, (acc["at"] + 1).cast("int"), F.lit(2**31 - 1))),
    )
    found = met(docs, spans, text_hash(F.col("text")), "left").select("row", "spans", F.when(F.col("spans").isNull(), text).otherwise(merged).alias("text"))
    changed = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("spans").isNull(), F.col("row.n_chars")).otherwise(F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return found.select(*(changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def _joined(spans: str):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_pii(table(spark, sf_dir, "documents"))

    def number_of(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [number_of(k) for k in KINDS[:4]]
    return out.select("doc_id", *counts, F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"))


QUERIES = {"op9_pii": op9_pii}
ORACLES: dict[str, str] = {}
