"""Line dedup with a fixed-depth template tree: lines of templates that recur across documents are dropped."""

from __future__ import annotations

import math
import operator
import struct
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, WordDigests, among, frugal, unlike

LEADING, MIN_DOCS, SIMILARITY = 3, 5, 0.8
WILD = "<*>"


def _tokens():
    """Tokens between spaces; a token with a digit is a variable field."""
    masked = F.when(F.col("line").rlike("[0-9]"), F.regexp_replace("line", "[^ 0-9]*+[0-9][^ ]*+", WILD)).otherwise(F.col("line"))
    return F.filter(F.split(masked, " "), lambda t: t != "")


def _lines(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line")).withColumn("t", _tokens()).where("size(t) > 0")


def line_keys(docs: DataFrame, leading: int = LEADING) -> DataFrame:
    """One row per line: hashes of the line, of its tokens with fields masked, of its leaf, and of each half in the leaf.

    The leaf is the place in a tree of fixed depth: number of tokens, then each of the ``leading`` first tokens.
    """
    n = F.size("t")
    leaf = F.xxhash64(n, F.slice("t", 1, leading))
    half = F.greatest(F.lit(1), F.floor(n / 2).cast("int"))
    return _lines(docs).select(
        "doc_id", F.xxhash64("line").alias("line"), F.xxhash64("t").alias("m"), n.alias("n"), leaf.alias("leaf"),
        F.xxhash64(leaf, F.lit(1), F.slice("t", F.lit(1), half)).alias("h1"),
        F.xxhash64(leaf, F.lit(2), F.slice("t", half + 1, F.greatest(F.lit(1), n))).alias("h2"),
    )


def merged(lines: list[list[str]], leading: int, similarity: float) -> list[int]:
    """For each masked line of one leaf, in order, the place of the line that began its template.

    A line goes into the template that has most of its tokens, the earliest among equals, if that is ``similarity`` of
    them; where they differ, the template varies from then on. Varying tokens equal none, so all lines of a template
    share so many. Two that differ in d later tokens share one of d + 1 runs of them: only those are compared.
    """
    n = len(lines[0])
    may = math.floor(n * (1 - similarity) + 1e-9)
    cuts = [leading + (n - leading) * j // (may + 1) for j in range(may + 2)]
    templates: dict[int, list[str | None]] = {}
    having: dict[tuple, list[int]] = {}
    out = []
    for k, line in enumerate(lines):
        runs = [(j, *line[a:b]) for j, (a, b) in enumerate(zip(cuts, cuts[1:]))]
        best, most = k, n - may - 1
        for c in sorted({c for r in runs for c in having.get(r, ())}):
            same = sum(map(operator.eq, templates[c], line))
            if same > most:
                best, most = c, same
        if best == k:
            templates[k] = list(line)
            for r in runs:
                having.setdefault(r, []).append(k)
        else:
            templates[best] = [x if x == y else None for x, y in zip(templates[best], line)]
        out.append(best)
    return out


def wildcards(tokens: list[str], leading: int, words: WordDigests) -> list[int]:
    """For each token behind the ``leading`` ones a digest of the line without it: of what stands before and behind."""
    own, link = [words[t.encode("utf-8")] for t in tokens], struct.Struct("<QQ").pack
    behind = [0]
    for d in reversed(own):
        behind.append(xxhash.xxh3_64_intdigest(link(behind[-1], d)))
    before, out = 0, []
    for j, d in enumerate(own):
        if j >= leading:
            out.append(_signed(xxhash.xxh3_64_intdigest(link(before, behind[len(own) - j - 1]), seed=j)))
        before = xxhash.xxh3_64_intdigest(link(before, d))
    return out


def recurring(docs: DataFrame, keys: DataFrame, scratch: Scratch, leading: int = LEADING, min_docs: int = MIN_DOCS, similarity: float = SIMILARITY) -> DataFrame:
    """``(m, first)``: masked lines with a recurring template, and the smallest document that has one of its templates.

    A template is a masked line, a set of masked lines of one leaf that differ in one later token only, or one that the
    template tree merges: lines of one leaf with ``similarity`` of their tokens alike. A line may belong to one of each.
    Lines that can differ in one token share one half; only those are spread out by token, each in time linear in its
    length. The tree takes the lines that may differ in two tokens or more, each leaf in order of first document.
    """
    by_m = scratch.write(keys.groupBy("m").agg(F.count_distinct("doc_id").alias("docs"), F.min("doc_id").alias("first"), F.first("n").alias("n"), F.first("leaf").alias("leaf"), F.first("h1").alias("h1"), F.first("h2").alias("h2")))
    exact = by_m.where(F.col("docs") >= min_docs).select("m", "first")
    least = max(leading + 1, math.ceil(1 / (1 - similarity) - 1e-9))
    halves = by_m.where(F.col("n") >= least).select("m", "first", "docs", F.explode(F.array("h1", "h2")).alias("h"))
    shared = halves.groupBy("h").agg(F.count("*").alias("k"), F.sum("docs").alias("d")).where((F.col("k") > 1) & (F.col("d") >= min_docs)).select("h")
    near = scratch.write(halves.join(shared, "h", "left_semi").select("m", "first").distinct())
    several = max(leading + 1, math.ceil(2 / (1 - similarity) - 1e-9))
    long = by_m.where(F.col("n") >= several)
    leaves = long.groupBy("leaf").agg(F.count("*").alias("k"), F.sum("docs").alias("d")).where((F.col("k") > 1) & (F.col("d") >= min_docs)).select("leaf")
    grown = scratch.write(long.join(leaves, "leaf", "left_semi").select("m", "leaf", "first"))
    wanted = near.unionByName(grown.select("m", "first"))
    if wanted.isEmpty():
        return scratch.write(exact)
    read = docs.select("doc_id", "text").where(among(wanted, "first")("doc_id"))  # a line is read where it stands first
    texts = scratch.write(_lines(read).where(F.size("t") >= least).select(F.xxhash64("t").alias("m"), "t").where(among(wanted, "m")("m")).groupBy("m").agg(F.first("t").alias("t")))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["first", "m"])
        m = pdf["m"].to_numpy()
        return pd.DataFrame({"m": m, "v": m[merged([list(t) for t in pdf["t"]], leading, similarity)]})

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordDigests()
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                v = [wildcards(t, leading, words) for t in part.column("t").to_pylist()]
                where = pa.array([k for k, x in enumerate(v) for _ in x], pa.int32())
                yield pa.RecordBatch.from_arrays([part.column("m").take(where), pa.array([x for y in v for x in y], pa.int64())], ["m", "v"])

    tree = texts.join(grown, "m").groupBy("leaf").applyInPandas(grow, "m long, v long").select("m", F.xxhash64(F.lit(WILD), "v").alias("v"))
    wild = texts.join(near.select("m"), "m", "left_semi").mapInArrow(frugal(spread), "m long, v long").distinct()
    all_ = scratch.write(wild.unionByName(tree))
    several = all_.groupBy("v").agg(F.count("*").alias("k")).where("k > 1").select("v")
    variants = scratch.write(all_.join(several, "v", "left_semi"))
    scratch.free(near, grown, texts, all_)
    of = keys.select("m", "doc_id").join(variants, "m").groupBy("v").agg(F.count_distinct("doc_id").alias("docs"), F.min("doc_id").alias("first"))
    looser = variants.join(of.where(F.col("docs") >= min_docs), "v").select("m", "first")
    out = scratch.write(exact.unionByName(looser).groupBy("m").agg(F.min("first").alias("first")))
    scratch.free(by_m, variants)
    return out


def drop_template_lines(spark: SparkSession, docs: DataFrame, leading: int = LEADING, min_docs: int = MIN_DOCS, similarity: float = SIMILARITY) -> DataFrame:
    """The documents without lines whose template occurs in ``min_docs`` documents or more, but for its first document.

    Adds ``_n_lines`` and ``_n_dropped`` (with more underscores if the documents have such columns), the last two
    columns; all others stay, with what is left of the text. Lines end at U+000A. Blank lines are never dropped. The
    first document is the one with the smallest id; repeats of a line within a document share its fate. A null text
    stays null and has one blank line. Rows with a null id lose nothing and count for no template; rows with the same
    id count as one document. An empty table gives no rows. Texts are sent only of documents that may lose a line.
    """
    scratch = Scratch(spark, "lines")
    keys = scratch.write(line_keys(docs, leading).where("doc_id is not null").groupBy("doc_id", "line", "m").agg(F.first("n").alias("n"), F.first("leaf").alias("leaf"), F.first("h1").alias("h1"), F.first("h2").alias("h2")))
    first = recurring(docs, keys, scratch, leading, min_docs, similarity)
    own, gone, n_lines, n_dropped = unlike(docs.columns, "_id", "_gone", "_n_lines", "_n_dropped")
    lost = keys.select("doc_id", "line", "m").join(first, "m").where("doc_id > first")
    lost = scratch.write(lost.groupBy(F.col("doc_id").alias(own)).agg(F.collect_list("line").alias(gone)))
    scratch.free(keys, first)

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = {f.name: b.column(k) for k, f in enumerate(b.schema)}
            texts, lines, dropped = [], [], []
            for text, out in zip(cols["text"].to_pylist(), cols.pop(gone).to_pylist()):
                own = (text or "").split("\n")
                bad = set(out or ())
                kept = [x for x in own if not x or _signed(xxhash.xxh64_intdigest(x.encode("utf-8"), 42)) not in bad] if bad else own
                texts.append("\n".join(kept) if bad else text)
                lines.append(len(own))
                dropped.append(len(own) - len(kept))
            cols |= {"text": pa.array(texts, pa.string()), n_lines: pa.array(lines, pa.int32()), n_dropped: pa.array(dropped, pa.int32())}
            yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    maybe = among(lost, own)(F.col("doc_id"))
    joined = docs.where(maybe).hint("merge").join(lost, F.col("doc_id") == F.col(own), "left").drop(own)
    schema = T.StructType([*docs.schema.fields, T.StructField(n_lines, T.IntegerType()), T.StructField(n_dropped, T.IntegerType())])
    whole = docs.where(~maybe).withColumn(n_lines, F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1))).withColumn(n_dropped, F.lit(0))
    return joined.mapInArrow(frugal(rebuild), schema).unionByName(whole)


def _signed(h: int) -> int:
    """The bits of an unsigned 64-bit number as Spark's signed one; xxh64 with seed 42 is what Spark gives for a string."""
    return h - (1 << 64) if h >> 63 else h
