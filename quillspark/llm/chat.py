r"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context, and only its text is trainable. A
conversation is formatted once, turn by turn, as ``<turn>role<text>text</turn>\n``; a backslash stands before every
backslash and ``<`` of a role or text, so control strings inside texts can't be taken for marks and come back as they
were. ``expand`` puts a row of its own behind every assistant turn: an example, which names the stretch of its conversation
that is its context, ``[0, loss_start)``, and the one that is trainable, ``[loss_start, loss_end)``. Context is stored once,
not once for every later turn, so output grows with the conversation rather than with its square; ``example_texts`` writes
examples out in full.

Turns are ordered by turn, then role, then text (nulls first), so repeated rows and ties have a fixed order. Null roles
and texts are empty. A conversation whose last turn is no assistant's, or that has none, ends in rows without a loss.
Conversations are streamed in turn order, one segment at a time: none is held whole. An empty table gives no rows; columns
other than conv_id, turn, role and text are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRAINED = "assistant"
_TURN = re.compile(r"<turn>((?:[^\\<]|\\.)*)<text>((?:[^\\<]|\\.)*)</turn>\n", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)

SEGMENTS = T.StructType().add("conv_id", T.LongType()).add("position", T.LongType()).add("segment", T.StringType()).add("start", T.LongType()).add("loss_start", T.LongType()).add("loss_end", T.LongType())
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long"


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\\<]", r"\\$0")


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def format_turns(conversations: DataFrame) -> DataFrame:
    """One row for each turn: its segment, where that starts in the conversation, and for assistants the trainable stretch.

    Formatting needs no order and happens before the one shuffle, by conversation; offsets are summed as turns stream by.
    """
    segment = F.concat(F.lit("<turn>"), escaped(F.col("role")), F.lit("<text>"), escaped(F.col("text")), F.lit("</turn>\n"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text", segment.alias("segment"), F.coalesce(F.col("role") == TRAINED, F.lit(False)).alias("trained"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "segment", "trained")
    before, after = len("<turn>" + TRAINED + "<text>"), len("</turn>\n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, position, at = object(), 0, 0
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for c, s, trained in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if c != conv:
                    conv, position, at = c, 0, 0
                for kept, v in zip(out, (position, at, at + before if trained else None, at + len(s) - after if trained else None), strict=True):
                    kept.append(v)
                position, at = position + 1, at + len(s)
            numbers = [pa.array(x, pa.int64()) for x in out]
            yield pa.RecordBatch.from_arrays([batch.column(0), numbers[0], pa.array(batch.column(1), pa.string()), *numbers[1:]], names=SEGMENTS.names)

    return rows.mapInArrow(run, SEGMENTS)


EXPANDED = ("conv_id", "position", "segment", "start", "context_end", "loss_start", "loss_end")


def expand(segments: DataFrame) -> DataFrame:
    """Turns and examples: each assistant turn exploded into its segment and an example of its own right behind it.

    A turn has ``segment`` and ``start``; an example has ``context_end``, ``loss_start`` and ``loss_end`` instead, in characters
    of its conversation. Rows keep their order and stay where they are.
    """
    no = F.lit(None).cast("long")
    turn = F.struct("segment", "start", no.alias("context_end"), no.alias("loss_start"), no.alias("loss_end"))
    example = F.struct(F.lit(None).cast("string").alias("segment"), no.alias("start"), F.col("loss_start").alias("context_end"), "loss_start", "loss_end")
    each = F.when(F.col("loss_start").isNotNull(), F.array(turn, example)).otherwise(F.array(turn))
    return segments.select("conv_id", "position", F.explode(each).alias("x")).select("conv_id", "position", "x.*")


def examples(expanded: DataFrame) -> DataFrame:
    """The examples alone: conv_id, position of the reply, and the stretches of context and reply."""
    return expanded.where("loss_start IS NOT NULL").select("conv_id", "position", "context_end", "loss_start", "loss_end")


def example_texts(segments: DataFrame) -> DataFrame:
    """Examples written out in full: conv_id, position, text up to the end of the reply, loss_start, loss_end.

    This is the square of a conversation's length; it is for conversations that fit a training sequence.
    """
    prefix = segments.select("conv_id", F.col("position").alias("__p"), "segment")
    pairs = examples(expand(segments)).drop("context_end").join(prefix, "conv_id").where(F.col("__p") <= F.col("position"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__p", "segment"))), lambda x: x["segment"]), "")
    whole = pairs.groupBy("conv_id", "position", "loss_start", "loss_end").agg(text.alias("text"))
    return whole.select("conv_id", "position", F.expr("substring(text, 1, loss_end)").alias("text"), "loss_start", "loss_end")


def digest(expanded: DataFrame) -> DataFrame:
    """What a reader gets back from the output, by conversation; ``expanded`` as ``expand`` streams it.

    Turns are read from segments, trained text from the stretches that examples name. ``formatted_chars`` counts the
    characters of all examples, and of the whole conversation once more where turns follow the last reply.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: dict | None = None

        def ended(x: dict) -> list:
            return [x["conv"], x["turns"], x["sha"].hexdigest(), x["loss"], x["loss_sha"].hexdigest(), x["chars"] + (x["end"] if x["open"] else 0), x["examples"]]

        for batch in batches:
            out = []
            for c, s, start, context, lo, hi in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5, 6)), strict=True):
                if now is None or c != now["conv"]:
                    if now:
                        out.append(ended(now))
                    now = {"conv": c, "turns": 0, "sha": hashlib.sha256(), "loss": 0, "loss_sha": hashlib.sha256(), "chars": 0, "start": 0, "end": 0, "open": True, "examples": 0, "segment": ""}
                if s is not None:
                    if start != now["end"]:
                        raise ValueError(f"a turn of conversation {c} begins at {start}, not where the one before it ends")
                    role, text = map(unescaped, _TURN.fullmatch(s).groups())
                    now["turns"] += 1
                    now["sha"].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                    now |= {"segment": s, "start": start, "end": start + len(s), "open": True}
                    continue
                if not now["start"] <= context == lo <= hi <= now["end"]:
                    raise ValueError(f"an example of conversation {c} is no reply to what stands before it")
                kept = unescaped(now["segment"][lo - now["start"] : hi - now["start"]])
                now["loss"] += len(kept)
                now["loss_sha"].update(kept.encode("utf-8", "surrogatepass"))
                now["chars"] += hi
                now["examples"] += 1
                now["open"] = False
            if out:
                yield _digests(out)
        if now:
            yield _digests([ended(now)])

    return expanded.select(*EXPANDED).mapInArrow(run, DIGEST)


def _digests(rows: list[list]) -> pa.RecordBatch:
    names = [f.split()[0] for f in DIGEST.split(", ")]
    types = [pa.string() if "string" in f else pa.int64() for f in DIGEST.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def op10_chat(spark, sf_dir: str) -> DataFrame:
    from quillspark.llm.common import table

    own = F.lit("\\### Assistant: </turn> ok")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), own.alias("text"))
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return digest(expand(format_turns(conversations.unionByName(probe))))


OP10_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), f AS (
  SELECT *, row_number() OVER w AS k, role = 'assistant' AS trained,
         length('<turn>' || regexp_replace(role, '[\\<]', '\\\0', 'g') || '<text>' || regexp_replace(text, '[\\<]', '\\\0', 'g') || '</turn>' || chr(10)) AS n
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
), s AS (
  SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY k) AS stop, max(k) OVER (PARTITION BY conv_id) AS last FROM f
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE trained), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE trained), '')) AS loss_sha256,
       CAST(coalesce(sum(stop - 8) FILTER (WHERE trained), 0) + coalesce(sum(stop) FILTER (WHERE k = last AND NOT trained), 0) AS BIGINT) AS formatted_chars,
       count(*) FILTER (WHERE trained) AS n_examples
FROM s GROUP BY conv_id
"""
