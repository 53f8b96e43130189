"""Operator 9, quality rules: base counts of words, symbols and repeats, and language-specific bands of n-gram perplexity.

The language model is a modified Kneser-Ney model of order ORDER over the characters (code points) of whole texts, one for each language.
Spark counts the n-grams of all distinct texts, and fits all languages at once by joins and aggregates: continuation counts, discounts from
the counts of counts, history totals, interpolated probabilities and back-off weights. No language is one task. The model is stored in arrays
sorted by the n-grams' 64-bit hashes, cut by hash range; every n-gram is kept. The texts that are scored are those that were counted, so each
of their n-grams stands in the highest order's arrays, and a text's log-probability is a sum over hash ranges: ranges are broadcast in groups
of MODEL_BYTES, each a pass over the documents of its languages, and the passes' sums are added up. What is broadcast has a fixed bound, and
the rule is the same at every size.

A document is rejected if the natural logarithm of its perplexity lies outside its language's band: the median of the language's distinct
texts that pass the base rules, plus and minus `width` times the quartile distance on that side. A text counts once however many copies it
has, in the model (each of n copies has the weight 1/n) and in the band.

Defined cases: a null or wordless text has all counts 0 and fails; a null lang is a language of its own; equal rows get equal results;
an empty table gives an empty result; columns of any name are carried along untouched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, fresh, frugal, lookup, mixed, per_row, runs, span_hashes, staged

ORDER = 4
#: Bits of a character in a packed n-gram; characters beyond the first plane share the codes of their low bits.
BITS = 16
#: Entries of a hash range's arrays, about.
RANGE_ROWS = 1 << 18
#: Bytes of text that are taken at once: every character needs some hundred bytes then.
PIECE_BYTES = 1 << 19
#: Bytes of models that one broadcast holds; beyond it texts are scored in several passes.
MODEL_BYTES = 192 << 20
#: Hashes of texts with copies that are broadcast; more go through a shuffled join.
COPIED = 300_000
#: Histogram cells per unit of log-perplexity.
CELLS = 200
#: How many quartile distances beyond the median a document may lie.
WIDTH = 8.0


def characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes of the characters of UTF-8 texts, offsets of the texts in them)."""
    begins = (data & 0xC0) != 0x80
    at = np.flatnonzero(begins)
    code = data[at].astype(np.uint64)
    wide = np.flatnonzero(code > 127)
    if len(wide):
        padded, own = np.append(data, np.zeros(3, np.uint8)), at[wide]
        b0, (b1, b2, b3) = code[wide], ((padded[own + k] & 63).astype(np.uint64) for k in (1, 2, 3))
        six = np.uint64(6)
        two = (b0 & np.uint64(31)) << six | b1
        three = ((b0 & np.uint64(15)) << six | b1) << six | b2
        four = (b1 << six | b2) << six | b3  # the first byte is beyond the low 16 bits
        code[wide] = np.where(b0 < 224, two, np.where(b0 < 240, three, four)) & np.uint64((1 << BITS) - 1)
    return code, np.concatenate([[0], np.cumsum(begins)])[offsets].astype(np.int64)


def grams(code: np.ndarray, offsets: np.ndarray, order: int = ORDER) -> np.ndarray:
    """The packed n-gram that ends at each character, the last one in the low bits; a document's first characters have zeros before them."""
    keys, place = code.copy(), np.arange(len(code)) - np.repeat(offsets[:-1], np.diff(offsets))
    for k in range(1, order):
        keys[k:] |= np.where(place[k:] >= k, code[:-k], np.uint64(0)) << np.uint64(BITS * k)
    return keys.view(np.int64)


def hashed(keys: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of 64-bit integers: a bijection."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda x, n: (x << np.uint64(n)) | (x >> np.uint64(64 - n))
    with np.errstate(over="ignore"):
        h = np.uint64(42 + 8) + p5
        h = turn(h ^ (turn(keys.view(np.uint64) * p2, 31) * p1), 27) * p1 + p4
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
        return (h ^ (h >> np.uint64(32))).view(np.int64)


def by_group(group: np.ndarray, offsets: np.ndarray):
    """(group, places) for each group of rows: the places between the offsets of its rows."""
    order = np.argsort(group, kind="stable")
    sizes = np.diff(offsets)
    cuts = np.flatnonzero(np.diff(group[order])) + 1
    for rows in np.split(order, cuts):
        n = sizes[rows]
        yield group[rows[0]], np.repeat(offsets[:-1][rows] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def text_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each document."""
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    starts, ends = runs(inside, offsets)
    n = len(offsets) - 1
    doc = np.searchsorted(offsets, starts, "right") - 1
    words = span_hashes(data, starts, ends)
    out = {"n_words": np.bincount(doc, minlength=n).astype(np.int64), "word_chars": per_row(inside & ((data & 0xC0) != 0x80), offsets), "n_symbols": per_row(np.isin(data, np.frombuffer(b"#*$%&|<>", np.uint8)), offsets)}
    line_starts, line_ends = runs(data != 10, offsets)
    if len(line_starts):
        worded = np.concatenate([[0], np.cumsum(inside)])
        keep = worded[line_ends] > worded[line_starts]
        line_starts, line_ends = line_starts[keep], line_ends[keep]
    line_doc = np.searchsorted(offsets, line_starts, "right") - 1
    again = _again(line_doc, span_hashes(data, line_starts, line_ends))
    lines, distinct = np.bincount(line_doc, minlength=n), np.bincount(line_doc[~again], minlength=n)
    out["n_dup_lines"] = (lines - distinct).astype(np.int64)
    covered = np.zeros(len(words), bool)
    if len(words) >= 3:
        with np.errstate(over="ignore"):
            tri = mixed(words[:-2] + mixed(words[1:-1] + mixed(words[2:]) * np.uint64(3)) * np.uint64(5))
        whole = np.flatnonzero(doc[:-2] == doc[2:])
        own = mixed(tri[whole] ^ mixed(doc[whole].astype(np.uint64)))
        order = np.argsort(own)
        same = own[order][1:] == own[order][:-1]
        twice = np.zeros(len(own), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        hit = whole[twice]
        for k in range(3):
            covered[hit + k] = True
    out["n_repeat_words"] = np.bincount(doc[covered], minlength=n).astype(np.int64)
    return out


def _again(doc: np.ndarray, value: np.ndarray) -> np.ndarray:
    """True where an earlier entry has the same doc and value."""
    _, first = np.unique(mixed(value ^ mixed(doc.astype(np.uint64))), return_index=True)
    out = np.ones(len(doc), bool)
    out[first] = False
    return out


# ---- the model ----


def lang_key(lang: F.Column) -> F.Column:
    """A language as a number; null is a language."""
    return F.xxhash64(lang.isNull(), lang)


def text_key(lang: F.Column, text: F.Column) -> F.Column:
    """64-bit hash of a language and a text."""
    return F.xxhash64(lang.isNull(), lang, text)


def count_grams(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """l (the language's key), gram, n over the distinct texts of each language; each task adds up its own before the shuffle."""

    def run(batches):
        held: dict = {}

        def pour():
            for lang, parts in held.items():
                keys, n = _summed(parts)
                yield pa.record_batch([pa.array(np.full(len(keys), lang, np.int64)), pa.array(keys), pa.array(n.astype(np.float64))], names=["l", "gram", "n"])
            held.clear()

        for batch in batches:
            langs, copies = batch.column("l").to_numpy(), batch.column("copies").to_numpy()
            for at, data, offsets in chunks(batch.column("text"), PIECE_BYTES):
                code, bounds = characters(data, offsets)
                keys, here = grams(code, bounds, order), copies[at : at + len(bounds) - 1]
                for lang, places in by_group(langs[at : at + len(bounds) - 1], bounds):
                    for value, rows in _by_copies(here, bounds, places):
                        low, n = np.unique(keys[rows], return_counts=True)
                        held.setdefault(lang, []).append((low, n / value))
                if sum(len(k) for parts in held.values() for k, _ in parts) > 1 << 20:
                    held = {lang: [_summed(parts)] for lang, parts in held.items()}
                    if sum(len(parts[0][0]) for parts in held.values()) > 1 << 19:
                        yield from pour()
        yield from pour()

    own = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).withColumn("key", text_key(F.col("lang"), F.col("text")))
    several = lookup(own.groupBy("key").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1"), COPIED)
    parts = own.join(several, "key", "left").select(lang_key(F.col("lang")).alias("l"), "text", F.coalesce("copies", F.lit(1)).alias("copies")).mapInArrow(frugal(run), "l long, gram long, n double")
    return parts.groupBy("l", "gram").agg(F.greatest(F.round(F.sum("n")), F.lit(1.0)).cast("long").alias("n"))


def _by_copies(copies: np.ndarray, bounds: np.ndarray, places: np.ndarray):
    """(copies, places) of texts with the same number of copies."""
    if (copies == 1).all():
        yield 1, places
        return
    own = np.repeat(copies, np.diff(bounds))[places]
    for value in np.unique(own):
        yield value, places[own == value]


def _summed(parts: list) -> tuple[np.ndarray, np.ndarray]:
    if len(parts) == 1:
        return parts[0]
    keys, where = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(where, np.concatenate([n for _, n in parts]), len(keys))


def _low(gram: F.Column, k: int) -> F.Column:
    """The last k characters of a packed n-gram."""
    return gram.bitwiseAND(F.lit((1 << BITS * k) - 1)) if BITS * k < 64 else gram


def fitted(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """l, k, gram, n, log_p, log_w: interpolated modified Kneser-Ney from the counts of the highest order, for each order k from 0 (one row a language) up; log_w is the back-off weight of the n-gram as a history.

    Every step is a join or an aggregate over all languages' n-grams, by language and n-gram.
    """
    tables = {order: staged(counts, "grams")}
    for k in range(order - 1, 0, -1):  # continuation counts: distinct left neighbours
        tables[k] = staged(tables[k + 1].groupBy("l", _low(F.col("gram"), k).alias("gram")).agg(F.count(F.lit(1)).alias("n")), "grams")
    few = None
    for k, t in tables.items():
        part = t.groupBy("l").agg(*(F.count(F.when(F.col("n") == i, 1)).cast("double").alias(f"n{i}") for i in (1, 2, 3, 4))).withColumn("k", F.lit(k))
        few = part if few is None else few.unionByName(part)
    n1, n2 = F.col("n1"), F.col("n2")
    y = F.when(n1 + n2 > 0, n1 / F.greatest(n1 + 2 * n2, F.lit(1.0))).otherwise(0.0)
    discount = lambda i, a, b: F.when(a > 0, F.least(F.greatest(i - (i + 1) * y * b / F.greatest(a, F.lit(1.0)), F.lit(0.0)), F.lit(float(i)))).otherwise(0.5 * y)
    rates = lookup(few.select("l", "k", *(discount(i, F.col(f"n{i}"), F.col(f"n{i + 1}")).alias(f"d{i}") for i in (1, 2, 3))))  # a row for each language and order
    cut, histories = {}, {}
    for k, t in tables.items():
        d = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        history = F.shiftrightunsigned("gram", BITS) if k > 1 else F.lit(0).cast("long")
        cut[k] = t.join(rates.where(F.col("k") == k).drop("k"), "l").select("l", "gram", "n", d.alias("d"), history.alias("history"))
        histories[k] = staged(cut[k].groupBy("l", "history").agg(F.sum("n").alias("total"), F.sum("d").alias("spare")).select("l", "history", "total", (F.col("spare") / F.col("total")).alias("w")), "histories")
    uniform = 1.0 / (1 << BITS)
    below = histories[1].select("l", F.col("history").alias("gram"), F.lit(0).cast("long").alias("n"), F.lit(uniform).alias("p"))  # a row for each language
    out = None
    for k in range(order + 1):
        if k:
            suffix = _low(F.col("gram"), k - 1) if k > 1 else F.lit(0).cast("long")
            joined = cut[k].join(histories[k], ["l", "history"]).withColumn("suffix", suffix).join(below.select("l", F.col("gram").alias("suffix"), F.col("p").alias("lower")), ["l", "suffix"])
            below = staged(joined.select("l", "gram", "n", ((F.col("n") - F.col("d")) / F.col("total") + F.col("w") * F.col("lower")).alias("p")), "grams")
        weighted = below.join(histories[k + 1].select("l", F.col("history").alias("gram"), "w"), ["l", "gram"], "left") if k < order else below.withColumn("w", F.lit(1.0))
        part = weighted.select("l", F.lit(k).alias("k"), "gram", "n", F.log(F.greatest("p", F.lit(1e-12))).alias("log_p"), F.log(F.greatest(F.coalesce("w", F.lit(1.0)), F.lit(1e-12))).alias("log_w"))
        out = part if out is None else out.unionByName(part)
    return out


def models(table: DataFrame, range_rows: int | None = None) -> DataFrame:
    """l, k, range, hash, log_p, log_w: arrays sorted by hash, a row for each language, order and hash range of about range_rows entries."""
    sizes = table.groupBy("l", "k").agg(F.count(F.lit(1)).alias("size"))
    bits = F.ceil(F.log2(F.col("size") / F.lit(range_rows or RANGE_ROWS))).cast("int")
    cut = table.join(lookup(sizes.select("l", "k", F.greatest(bits, F.lit(0)).alias("bits"))), ["l", "k"]).withColumn("hash", F.xxhash64("gram"))
    own = F.when(F.col("bits") > 0, F.expr("shiftright(hash, 64 - bits)")).otherwise(F.lit(0).cast("long"))
    ranges = cut.groupBy("l", "k", own.alias("range")).agg(F.sort_array(F.collect_list(F.struct("hash", "log_p", "log_w"))).alias("e"))
    return ranges.select("l", "k", "range", F.col("e")["hash"].alias("hash"), *(F.col("e")[c].cast("array<float>").alias(c) for c in ("log_p", "log_w")))


def loaded(rows: pa.Table) -> dict[int, list]:
    """l -> for each order from 0 (hashes, log-probabilities, log-weights)."""
    out: dict[int, list] = {}
    order = rows.sort_by([("l", "ascending"), ("k", "ascending"), ("range", "ascending")])
    for lang, k, h, p, w in zip(*(order.column(c) for c in ("l", "k", "hash", "log_p", "log_w")), strict=True):
        levels = out.setdefault(lang.as_py(), [])
        while len(levels) <= k.as_py():
            levels.append(([], [], []))
        for have, new in zip(levels[k.as_py()], (h, p, w), strict=True):
            have.append(new.values.to_numpy(zero_copy_only=False))
    joined = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)  # noqa: E731  an order that isn't among the rows
    return {lang: [tuple(map(joined, level)) for level in levels] for lang, levels in out.items()}


class Sorted:
    """Finds hashes in a sorted array: their first bits say where they begin."""

    def __init__(self, h: np.ndarray):
        self.shift = np.int64(64 - max(4, len(h).bit_length()))
        self.base = 1 << (63 - int(self.shift))
        self.first = np.concatenate([[0], np.cumsum(np.bincount((h >> self.shift) + self.base, minlength=2 * self.base))]).astype(np.int32)
        self.h = np.append(h, np.iinfo(np.int64).max)

    def __call__(self, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, whether the hash stands there)."""
        at = self.first[(want >> self.shift) + self.base]
        found = self.h[at]
        left = np.flatnonzero(found < want)
        while len(left):
            at[left] += 1
            found[left] = self.h[at[left]]
            left = left[found[left] < want[left]]
        return at, (found == want) & (at < len(self.h) - 1)


def ready(model: list) -> list:
    """A model's levels with their finders."""
    return [(Sorted(h), p, w) for h, p, w in model]


def log_probabilities(levels: list, keys: np.ndarray) -> np.ndarray:
    """Natural log-probability of each packed n-gram's last character given those before it, backing off where it was never seen. levels: of `ready`."""
    out, left, scale = np.zeros(len(keys)), np.arange(len(keys)), np.zeros(len(keys))
    for k in range(len(levels) - 1, -1, -1):
        find, p, _ = levels[k]
        own = keys[left] if k * BITS >= 64 else keys[left] & np.int64((1 << BITS * k) - 1)
        spot, seen = find(hashed(own))
        out[left[seen]] = p[spot[seen]] + scale[left[seen]]
        left, own = left[~seen], own[~seen]
        if not len(left):
            break
        find, _, weight = levels[k - 1]
        spot, seen = find(hashed((own.view(np.uint64) >> np.uint64(BITS)).view(np.int64)))
        scale[left[seen]] += weight[spot[seen]]
    return out


_FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
METRICS = "struct<n_words:long,word_chars:long,n_symbols:long,n_dup_lines:long,n_repeat_words:long,n_codes:long,log_sum:double>"


def grouped_ranges(sizes: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(language, range, pass) for (language, range, entries): consecutive ranges share a pass as long as they fit MODEL_BYTES."""
    number, size, out = 0, 0, []
    for lang, part, n in sizes:
        if size and size + 16 * n > MODEL_BYTES:
            number, size = number + 1, 0
        out.append((lang, part, number))
        size += 16 * n
    return out


def log_sums(known: dict, langs: np.ndarray, code: np.ndarray, bounds: np.ndarray, order: int) -> np.ndarray:
    """The sum of each text's log-probabilities, over those n-grams that stand in `known`: language -> (finder, log-probabilities)."""
    keys, logs = grams(code, bounds, order), np.zeros(len(code))
    for lang, places in by_group(langs, bounds):
        if len(places) and lang in known:
            find, p = known[lang]
            spot, seen = find(hashed(keys[places]))
            logs[places[seen]] = p[spot[seen]]
    return per_row(logs, bounds)


def measured(docs: DataFrame, carry: list[str], column: str, order: int = ORDER) -> DataFrame:
    """The carried columns of docs and a struct of counts and log-perplexity; hash ranges are scored in groups that fit MODEL_BYTES."""
    spark = docs.sparkSession
    table = staged(models(fitted(count_grams(docs, order), order).where(F.col("k") == order)), "kn-models")
    sizes = table.select("l", "range", F.size("hash").alias("n")).orderBy("l", "range").collect()  # a row for each language and range
    passes = grouped_ranges([tuple(r) for r in sizes])
    several = bool(passes) and passes[-1][2] > 0
    text, lang_of, row = (fresh(x, [*docs.columns, *carry]) for x in ("text_in", "lang_in", "row_in"))
    own = docs.select(*carry, F.col("text").cast("string").alias(text), lang_key(F.col("lang").cast("string")).alias(lang_of))
    if several:
        own = staged(own.withColumn(row, F.monotonically_increasing_id()), "quality-input")
    groups = spark.createDataFrame(passes, "l long, range long, g int")
    kept = [*carry, *([row] if several else [])]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.select(*kept).schema.fields) + f", `{column}` {METRICS}"
    first, more = None, None
    for i in range(passes[-1][2] + 1 if passes else 1):
        rows = table.join(F.broadcast(groups.where(F.col("g") == i)), ["l", "range"]).drop("g") if several else table
        shared = spark.sparkContext.broadcast(loaded(rows.toArrow()))  # MODEL_BYTES, or one range

        def run(batches, shared=shared, counting=i == 0):
            known = {lang: (Sorted(levels[order][0]), levels[order][1]) for lang, levels in shared.value.items()}
            for batch in batches:
                langs = batch.column(batch.num_columns - 1).to_numpy()
                got: list[dict] = []
                for at, data, offsets in chunks(batch.column(batch.num_columns - 2), PIECE_BYTES):
                    counts = text_counts(data, offsets) if counting else {}
                    code, bounds = characters(data, offsets)
                    counts["n_codes"], counts["log_sum"] = np.diff(bounds), log_sums(known, langs[at : at + len(offsets) - 1], code, bounds, order)
                    got.append(counts)
                if counting:
                    metrics = pa.StructArray.from_arrays([pa.array(np.concatenate([g[f] for g in got])) for f in (*_FIELDS, "n_codes", "log_sum")], [*_FIELDS, "n_codes", "log_sum"])
                    yield pa.RecordBatch.from_arrays([*batch.columns[:-2], metrics], names=[*batch.schema.names[:-2], column])
                else:
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate([g["log_sum"] for g in got]))], names=[row, "more"])

        if i == 0:
            first = own.select(*kept, text, lang_of).mapInArrow(frugal(run), schema)
        else:  # only texts of the pass's languages
            langs = lookup(groups.where(F.col("g") == i).select(F.col("l").alias(lang_of)).distinct())
            part = own.join(langs, lang_of, "left_semi").select(row, text, lang_of).mapInArrow(frugal(run), f"`{row}` long, more double")
            more = part if more is None else more.unionByName(part)
    m, log_sum = F.col(column), F.col(column)["log_sum"]
    if several:
        added = more.groupBy(F.col(row).alias(row + "_of")).agg(F.sum("more").alias(row + "_sum"))
        first = first.join(added, F.col(row) == F.col(row + "_of"), "left")
        log_sum = log_sum + F.coalesce(F.col(row + "_sum"), F.lit(0.0))
    log_ppl = (-log_sum / F.greatest(m["n_codes"], F.lit(1))).alias("log_ppl")
    return first.select(*carry, F.struct(*(m[f].alias(f) for f in _FIELDS), log_ppl).alias(column))


def base_failed(m) -> F.Column:
    return (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])


def bands(rows: DataFrame, column: str, lang: str, key: str, width: float = WIDTH) -> DataFrame:
    """band_lang, low, high: from a histogram of each language's log-perplexities, over all distinct texts (by `key`) that pass the base rules."""
    from pyspark.sql import Window

    m = F.col(column)
    texts = rows.where(~base_failed(m)).groupBy(F.col(lang).alias("band_lang"), F.col(key).alias("key")).agg(F.min(F.floor(m["log_ppl"] * CELLS)).alias("cell"))
    cells = texts.groupBy("band_lang", "cell").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("band_lang")  # a row for each cell: log-perplexity is at most a few dozen
    run = cells.withColumns({"upto": F.sum("n").over(w.orderBy("cell")), "every": F.sum("n").over(w)})
    mid = [F.min(F.when(F.col("upto") >= F.col("every") * q, F.col("cell") + 0.5)) / CELLS for q in (0.25, 0.5, 0.75)]
    q1, q2, q3 = (F.col(x) for x in ("q1", "q2", "q3"))
    least = F.lit(2.0 / CELLS)
    return run.groupBy("band_lang").agg(*(x.alias(f"q{i + 1}") for i, x in enumerate(mid))).select("band_lang", (q2 - width * F.greatest(q2 - q1, least)).alias("low"), (q2 + width * F.greatest(q3 - q2, least)).alias("high"))


def judged(docs: DataFrame, carry: list[str], order: int = ORDER, width: float = WIDTH) -> tuple[DataFrame, str, str]:
    """(carried columns with a metrics struct and a verdict, their names). The verdict is true for a kept document."""
    column, kept = fresh("quality_metrics", [*docs.columns, *carry]), fresh("quality_kept", [*docs.columns, *carry])
    lang = fresh("quality_lang", [*docs.columns, *carry])
    key = fresh("quality_key", [*docs.columns, *carry])
    with_lang = docs.withColumn(lang, F.col("lang").cast("string")).withColumn(key, text_key(F.col(lang), F.col("text").cast("string")))
    rows = staged(measured(with_lang, [*carry, lang, key], column, order), "quality-metrics")
    names = {x: fresh(x, [*docs.columns, *carry]) for x in ("band_lang", "low", "high")}
    found = lookup(bands(rows, column, lang, key, width)).withColumnsRenamed(names)
    m = F.col(column)
    inside = m["log_ppl"].between(F.col(names["low"]), F.col(names["high"]))
    out = rows.join(found, F.col(lang).eqNullSafe(F.col(names["band_lang"])), "left").withColumn(kept, ~base_failed(m) & F.coalesce(inside, F.lit(True)))
    return out.drop(*names.values(), lang, key), column, kept


def quality_filter(docs: DataFrame, order: int = ORDER, width: float = WIDTH) -> DataFrame:
    """The documents that pass the base rules and lie within their language's band, with their own columns."""
    out, _, kept = judged(docs, docs.columns, order, width)
    return out.where(F.col(kept)).select(*docs.columns)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out, column, kept = judged(docs, ["doc_id"])
    m = F.col(column)
    return out.select("doc_id", *(m[f].alias(f) for f in _FIELDS), base_failed(m).alias("base_failed"), F.col(kept).alias("kept"), m["log_ppl"].alias("log_perplexity"))
