"""Line deduplication by winnowing over line hashes.

A document is the sequence of its non-blank lines, stripped.  Of every window
of ``run`` consecutive lines the smallest line hash is a fingerprint, and so is
every line of ``long_words`` words or more: any run of ``run`` equal lines in
two places, or such a line, has a fingerprint in both.  Fingerprints that stand
in one place only are left out by a join on their counts; the others are
extended to both sides, to each window of lines that holds them.  A window that
an earlier place (by doc_id, then line) holds too is repeated; repeated windows
that touch make runs, and their lines are deleted.

That equals extending each match line by line as far as it goes: a run of
``run`` lines or more that stands earlier too is the union of its windows, each
of which holds a fingerprint, at the same line of the window in both places;
and no other line lies in a repeated window.

Nothing is compared pair by pair: the first place of each window is a minimum,
so a line that stands in a third of all documents costs one row for each.
Lines are compared whole: a passage inside a longer line is not found.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenspan.llm.common import bound_batches, broadcast_small, chunks, lean, materialize
from lumenspan.llm.decontamination import gram_hashes, winnow

RUN, LONG_WORDS = 2, 50
_LONG = np.uint64(0x5851F42D4C957F2D)


def line_units(text: bytes) -> tuple[list[bytes], list[int]]:
    """All lines, and the numbers of those that are not blank."""
    lines = text.split(b"\n")
    return lines, [i for i, x in enumerate(lines) if x.strip()]


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("dkey"), text.alias("text"))


def _anchors(docs: DataFrame, run: int, long_words: int) -> DataFrame:
    """A row for each fingerprint: (fp, doc_id, dkey, windows), where windows
    are (key, first unit, units) of what it extends to."""

    def go(batches):
        for batch, texts in chunks(batches):
            fps, docs_, keys_, starts, sizes, owner = [], [], [], [], [], []
            for row, (doc, dkey, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, strict=True)):
                lines, units = line_units(text)
                if not units:
                    continue
                body = [lines[i].strip() for i in units]
                h = pd.util.hash_array(np.array(body, dtype=object), categorize=False)
                long_ = np.array([len(x.split()) >= long_words for x in body])
                wide = gram_hashes(h, run)
                least = np.zeros(len(h), bool)
                if len(h) >= run:
                    least[winnow(h, run)] = True
                for p in np.flatnonzero(least | long_).tolist():
                    got = [(int(wide[s]), s, run) for s in range(max(0, p - run + 1), min(p, len(wide) - 1) + 1)] if least[p] else []
                    if long_[p]:
                        got.append((int(h[p] ^ _LONG), p, 1))
                    for key, s, size in got:
                        fps.append(int(h[p]))
                        docs_.append(doc)
                        owner.append(dkey)
                        keys_.append(key)
                        starts.append(s)
                        sizes.append(size)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(fps, np.uint64).astype(np.int64)), pa.array(docs_, pa.int64()), pa.array(owner, pa.int64()), pa.array(np.array(keys_, np.uint64).astype(np.int64)), pa.array(starts, pa.int32()), pa.array(sizes, pa.int32())],
                names=["fp", "doc_id", "dkey", "key", "start", "size"],
            )

    return docs.mapInArrow(lean(go), "fp bigint, doc_id bigint, dkey bigint, key bigint, start int, size int")


def repeated_windows(docs: DataFrame, *, run: int = RUN, long_words: int = LONG_WORDS) -> DataFrame:
    """(doc_id, dkey, start, size) of each window that stands earlier too."""
    bound_batches(docs.sparkSession)
    anchors = materialize(_anchors(_keyed(docs), run, long_words), "anchors")
    # each side of these joins is a table of its own, so that a line or a run that a third of all rows hold is split
    common = materialize(anchors.groupBy("fp").agg(F.count("*").alias("n")).where("n > 1").select("fp"), "common")
    places = anchors.join(common, "fp", "left_semi").select("key", "size", "doc_id", "dkey", "start")
    first = places.groupBy("key", "size").agg(F.min(F.struct("doc_id", "dkey", "start")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    first = materialize(first, "first")
    here = F.struct("doc_id", "dkey", "start")
    return anchors.join(first, ["key", "size"]).where(~here.eqNullSafe(F.col("first"))).select("doc_id", "dkey", "start", "size").distinct()


def deduplicate(docs: DataFrame, *, run: int = RUN, long_words: int = LONG_WORDS) -> DataFrame:
    """Per row of docs: doc_id, n_lines (non-blank), n_removed, runs (array of
    (first, last) non-blank line numbers removed) and text without them.

    The first place of a run stays: the one with the smallest doc_id (NULL
    before all), then by text hash among rows that repeat an id, then by line.
    Rows that repeat both id and text are one document and lose the same
    lines.  Blank lines are neither compared nor removed.  NULL and empty texts
    have no lines and become empty.  An empty table gives no row; other columns
    are not read.
    """
    lists = materialize(repeated_windows(docs, run=run, long_words=long_words).groupBy("doc_id", "dkey").agg(F.collect_list(F.struct("start", "size")).alias("gone")), "repeats")
    lists = lists.select(F.col("doc_id").alias("_id"), F.col("dkey").alias("_key"), "gone")
    src = _keyed(docs)
    rows = src.join(broadcast_small(lists, 60 + 16 * F.size("gone")), src.doc_id.eqNullSafe(F.col("_id")) & (F.col("dkey") == F.col("_key")), "left").select("doc_id", "text", "gone")

    def cut(batches):
        for batch, texts in chunks(batches):
            count, gone, runs, out = [], [], [], []
            for text, windows in zip(texts, batch.column(2).to_pylist(), strict=True):
                lines, units = line_units(text)
                drop = np.zeros(len(units), bool)
                for w in windows or []:
                    drop[w["start"] : w["start"] + w["size"]] = True
                edge = np.flatnonzero(np.diff(np.r_[0, drop.astype(np.int8), 0]))
                runs.append([{"first": int(a), "last": int(b) - 1} for a, b in zip(edge[::2], edge[1::2], strict=True)])
                lost = {units[i] for i in np.flatnonzero(drop)}
                count.append(len(units))
                gone.append(len(lost))
                out.append(b"\n".join(x for i, x in enumerate(lines) if i not in lost).decode())
            span = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, span), pa.array(out, pa.string())], names=["doc_id", "n_lines", "n_removed", "runs", "text"])

    return rows.mapInArrow(lean(cut), "doc_id bigint, n_lines bigint, n_removed bigint, runs array<struct<first:int,last:int>>, text string")


ORACLE_SQL = r"""
with l as (
  select doc_id, i, line, trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as s from (
    select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i from documents)),
u as (select doc_id, i, s, row_number() over (partition by doc_id order by i) as p, lead(s) over (partition by doc_id order by i) as nxt,
    len(regexp_extract_all(s, '[^\x20\x09-\x0D]+')) >= 50 as long from l where s <> ''),
w as (select doc_id, p, (doc_id, p) <> min((doc_id, p)) over (partition by s, nxt) as again from u where nxt is not null),
o as (select doc_id, p, (doc_id, p) <> min((doc_id, p)) over (partition by s) as again from u where long),
gone as (select doc_id, p from w where again union select doc_id, p + 1 from w where again union select doc_id, p from o where again),
x as (select l.doc_id, l.i, l.line, u.p, g.p is not null as lost from l left join u using (doc_id, i) left join gone g on g.doc_id = u.doc_id and g.p = u.p)
select doc_id, count(p)::bigint as n_lines, count(*) filter (lost)::bigint as n_removed,
  md5(coalesce(string_agg(line, chr(10) order by i) filter (not lost), '')) as text_md5 from x group by doc_id
"""
