"""Operator 3, line dedup: suffixes of the line sequence are named by distributed prefix doubling, intervals with a long common prefix lose all copies but the first."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.llm.common import lookup, running_start, slices, small_batches, stored, trim, with_minimum, words_of

#: Words that a repeated run must have for its later copies to go.
MIN_WORDS = 50


def line_rows(docs: DataFrame, min_words: int) -> DataFrame:
    """``docs(rid, text)`` -> a row for each line: ``rid, idx, left`` (lines from here to the text's end), ``line`` (its 128-bit number), ``need``
    (lines from here that first have ``min_words`` words; 0 if the text ends before), ``most`` (lines from here to the last line before which
    nothing later than this one has ``min_words`` words; 0 with ``need``).

    A run of ``min_words`` words is covered by those of its parts that lose enough words with their last line (``need``) or with their first:
    these have ``need`` to ``most`` lines, at most one of them ends at each line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(1)):
                rid, texts = batch.column(0).slice(part.start, part.stop - part.start), pc.fill_null(batch.column(1).slice(part.start, part.stop - part.start), "")
                parts = pc.split_pattern(texts, "\n")
                n = np.diff(parts.offsets.to_numpy()).astype(np.int64)
                coded = parts.values.dictionary_encode()
                codes, distinct = coded.indices.to_numpy(), coded.dictionary
                numbers = pa.array([hashlib.blake2b(x, digest_size=16).digest() for x in distinct.cast(pa.binary()).to_pylist()], pa.binary())
                words = words_of(distinct).counts[codes]
                ends = np.cumsum(n)
                at, end = np.arange(len(codes)), np.repeat(ends, n)
                total = np.cumsum(words)
                reach = np.searchsorted(total, total - words + min_words) + 1
                need = np.where(reach <= end, reach - at, 0)
                after = np.append(reach[1:], len(codes) + 1)
                most = np.where(need > 0, np.maximum(need, np.minimum(after - 1, end) - at), 0)
                out = pa.RecordBatch.from_arrays(
                    [rid.take(pa.array(np.repeat(np.arange(len(n)), n))), pa.array(at - np.repeat(ends - n, n)), pa.array(end - at), numbers.take(pa.array(codes)), pa.array(need), pa.array(most)],
                    names=["rid", "idx", "left", "line", "need", "most"],
                )
                del rid, texts, parts, coded, codes, distinct, numbers, words, at, end, total, reach, need, after, most
                yield out
                del out
                trim()

    return docs.mapInArrow(run, "rid long, idx long, left long, line binary, need long, most long")


def repeated_runs(lines: DataFrame, order: DataFrame) -> DataFrame:
    """``rid, idx, need, first`` for every suffix and each number of lines from its ``need`` to its ``most`` that also start an earlier suffix; ``first`` is
    the position of the first of them.

    ``order(rid, doc_id)`` puts the texts in a row by doc_id, so every line has a position. Level k names each stretch of 2^k lines by the
    position of its first copy, from two names of level k - 1; a stretch without a second copy has no name and drops out, so
    levels shrink fast. Two overlapping stretches name any length between two powers. Suffixes with one name for so many first lines are an
    interval of the suffix array with that common prefix.
    """
    starts = running_start(lines.where("idx = 0").select("rid", F.col("left").alias("n")).join(order, "rid"), ["doc_id", "rid"], "n").select("rid", "start")
    again = lines.groupBy("line").agg(F.count("*").alias("n")).where("n > 1").select("line", F.lit(True).alias("again"))
    rows = lookup(lines, again, "line", "rid").where("again").drop("again")
    rows = rows.join(starts, "rid").withColumn("pos", F.col("start") + F.col("idx")).select("pos", "rid", "idx", "left", "need", "most", "line")
    level = stored(with_minimum(rows, "line", "pos", "name").drop("line"), "level")
    found, length = [], 1
    while True:
        here = level.where((F.col("need") > 0) & (F.col("most") >= length) & (F.col("need") < 2 * length))
        here = here.withColumn("need", F.explode(F.sequence(F.greatest("need", F.lit(length)), F.least("most", F.lit(2 * length - 1)))))
        tail = level.select(F.col("pos").alias("_pos"), F.col("name").alias("_name"))
        ends = here.join(tail, here["pos"] + here["need"] - length == tail["_pos"]).withColumn("run", F.concat_ws(" ", "need", "name", "_name"))
        found.append(stored(with_minimum(ends.select("run", "pos", "rid", "idx", "need"), "run", "pos", "first", least_rows=2).where("pos > first").select("rid", "idx", "need", "first"), "runs"))
        longer = level.where(F.col("left") >= 2 * length)
        pairs = longer.join(tail, longer["pos"] + length == tail["_pos"]).withColumn("pair", F.concat_ws(" ", "name", "_name")).drop("name", "_name", "_pos")
        level = stored(with_minimum(pairs, "pair", "pos", "name", least_rows=2).drop("pair"), "level")
        length *= 2
        if not (level.agg(F.max("most")).first()[0] or 0) >= length:
            break
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def without_lines(text: str, gone: str):
    """Text without the lines that the ``gone`` intervals (arrays of first line and number) cover; null if no line is left or ``gone`` is null."""

    @F.arrow_udf("struct<text:string,n_deleted:long>")
    def run(texts: pa.Array, intervals: pa.Array) -> pa.Array:
        out, deleted = [], []
        for text_, own in zip(texts, intervals.to_pylist(), strict=True):
            if own is None:
                out.append(None)
                deleted.append(0)
                continue
            parts = text_.as_py().split("\n")
            mark = np.zeros(len(parts) + 1, dtype=np.int64)
            for x in own:
                mark[x["idx"]] += 1
                mark[x["idx"] + x["need"]] -= 1
            drop = np.cumsum(mark[:-1]) > 0
            left = [p for p, d in zip(parts, drop.tolist(), strict=True) if not d]
            out.append("\n".join(left) if left else None)
            deleted.append(int(drop.sum()))
        trim()
        return pa.StructArray.from_arrays([pa.array(out, pa.string()), pa.array(deleted, pa.int64())], names=["text", "n_deleted"])

    return run(text, gone)


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of ``docs`` as a struct ``doc`` with their new ``text`` and the columns ``n_lines, n_deleted``.

    Texts follow each other by doc_id (nulls last, rows of one doc_id in the table's order). A line goes if it lies in a run of lines, at least
    ``min_words`` words long and within one text, that also stands earlier; so maximal repeated runs vanish to their last line but for their first copy, and every deleted line equals one that stays
    before it. Lines are what stands between ``\\n`` and are equal if all characters are.

    A text that loses all its lines becomes null. A null text counts as one empty line and stays null. Other columns pass through whatever
    their names. An empty table gives an empty result.
    """
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    n_lines = F.coalesce(F.regexp_count(F.col(text), F.lit("\n")), F.lit(0)).cast("long") + 1
    held = stored(docs.select(F.monotonically_increasing_id().alias("rid"), F.col(doc_id).cast("long").alias("doc_id"), n_lines.alias("n_lines"), whole.alias("doc")), "documents", "zstd")
    body = held.select("rid", F.col("doc")[text].alias("text"))
    with small_batches(docs.sparkSession):
        lines = stored(line_rows(body, min_words), "lines")
    runs = repeated_runs(lines, held.select("rid", "doc_id"))
    # documents stream past a table of the small rows: a sort-merge join would hold and sort them
    gone = stored(runs.groupBy("rid").agg(F.collect_list(F.struct("idx", "need")).alias("gone")), "gone").hint("shuffle_hash")
    marked = held.join(gone, "rid", "left").withColumn("_new", without_lines(F.when(F.col("gone").isNotNull(), F.col("doc")[text]), F.col("gone")))
    new = F.col("doc").withField(f"`{text}`", F.when(F.col("gone").isNull(), F.col("doc")[text]).otherwise(F.col("_new.text")))
    # a condition of the caller on n_deleted would run the cut a second time, in a second worker for each task, if it were not written
    with small_batches(docs.sparkSession):
        return stored(marked.select(new.alias("doc"), "n_lines", F.coalesce("_new.n_deleted", F.lit(0)).cast("long").alias("n_deleted")), "deleted", "zstd")


def keep_new_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with later copies of repeated runs deleted; a document without any other line goes."""
    done = dedup_lines(docs, doc_id, text, min_words)
    return done.where("n_deleted = 0 OR n_deleted < n_lines").select("doc.*")
