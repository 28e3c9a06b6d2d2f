r"""Chat formatting with prefix-target expansion: every assistant turn is an example of its own.

A turn is written as ``<|im_start|>role``, newline, text, ``<|im_end|>``, newline. ``<``, any number
of backslashes and ``|`` in a role or text gets one backslash more, so the control strings can't
stand there and the text can be told again; a role's newlines and backslashes are escaped as well.

An example's context is all turns before its reply, and only the reply's text is trainable. Written
out, the contexts of a conversation grow with the square of its turns. The output therefore has each
formatted turn once (``turns``: place and start in the conversation's stream) and the exploded
examples (``examples``): the context is the stream from 0 to ``context_chars``, the loss mask is
``loss_start`` to ``loss_end``, the example ends at ``chars``; all are code points. ``pieces``
puts any example together again, piece by piece. Turns after the last reply, or all of a
conversation without one, are a last example with an empty mask, so that nothing is lost.

Conversations are dealt out by ranges of (id, turn), so one with any share of the rows is spread;
its places and starts are running sums (see ``numbering``). A digest of a whole conversation follows from one
sequence, so ``digests`` reads each conversation as a stream in one task, which holds a batch of it.

Rows go by turn, null turns first, equal turns by role and text; repeated rows are turns of their
own. Null texts and roles are empty. A null id is a conversation. An empty table gives an empty
output. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinquery.operators.numbering import carries, group_key, in_ranges, running, with_carries

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
REPLY = "assistant"
_SUMS = {"place": "__one", "start": "chars", "replies": "__reply"}


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescaped(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def _role(role: Column) -> Column:
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def parsed(piece: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    if not (piece.startswith(OPEN) and piece.endswith(CLOSE + "\n")):
        raise ValueError("not a formatted turn")
    role, text = piece[len(OPEN) : -len(CLOSE) - 1].split("\n", 1)
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescaped(role)), unescaped(text)


def write_examples(conversations: DataFrame, path: str) -> None:
    """Write ``turns``, ``carries`` (a row a partition at most) and ``examples`` below ``path``."""
    spark = conversations.sparkSession
    rows = conversations.select(F.col("conv_id"), group_key(F.col("conv_id")).alias("grp"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = in_ranges(rows, "grp", ["turn", "role", "text"])
    head, body = F.concat(F.lit(OPEN), _role(F.col("role")), F.lit("\n")), escaped(F.col("text"))
    pieces = dealt.select(
        "conv_id", "grp", "__part", F.concat(head, body, F.lit(CLOSE + "\n")).alias("piece"), F.length(head).alias("head"), F.length(body).alias("body"), (F.col("role") == REPLY).alias("reply")
    )
    pieces = pieces.select("*", F.length("piece").cast("long").alias("chars"), F.col("reply").cast("long").alias("__reply"), F.lit(1).cast("long").alias("__one"))
    laid = running(pieces, "grp", _SUMS).drop("__one", "__reply")
    laid.write.option("compression", "zstd").parquet(f"{path}/turns")
    turns = spark.read.schema(laid.schema).parquet(f"{path}/turns")
    carries(turns.select("__part", "__row", "grp", "chars", *_SUMS, F.lit(1).cast("long").alias("__one"), F.col("reply").cast("long").alias("__reply")), "grp", _SUMS).write.parquet(f"{path}/carries")
    _examples(read_turns(spark, path)).write.parquet(f"{path}/examples")


def read_turns(spark: SparkSession, path: str) -> DataFrame:
    """conv_id, grp, piece, head and body (code points of both), reply, chars, place, start, replies (before this turn)."""
    return with_carries(spark.read.parquet(f"{path}/turns"), spark.read.parquet(f"{path}/carries"), list(_SUMS))


def _examples(turns: DataFrame) -> DataFrame:
    """An example a reply, and one without a reply for the turns after a conversation's last."""
    end = F.col("start") + F.col("chars")
    replies = turns.where("reply").select(
        "conv_id", "grp", F.col("replies").alias("example"), F.col("place").alias("reply_place"), F.col("start").alias("context_chars"), (F.col("start") + F.col("head")).alias("loss_start"), (F.col("start") + F.col("head") + F.col("body")).alias("loss_end"), end.alias("chars")
    )
    last = turns.groupBy("grp").agg(F.first("conv_id").alias("conv_id"), F.max(F.struct("place", "replies", "reply", end.alias("end"))).alias("t")).where(~F.col("t.reply"))
    rest = last.select("conv_id", "grp", F.col("t.replies").alias("example"), F.lit(None).cast("long").alias("reply_place"), F.col("t.end").alias("context_chars"), F.col("t.end").alias("loss_start"), F.col("t.end").alias("loss_end"), F.col("t.end").alias("chars"))
    return replies.unionByName(rest)


def read_examples(spark: SparkSession, path: str) -> DataFrame:
    """conv_id, grp, example, reply_place, context_chars, loss_start, loss_end, chars."""
    return spark.read.parquet(f"{path}/examples")


def pieces(spark: SparkSession, path: str, examples: DataFrame) -> DataFrame:
    """Examples written out: conv_id, example, place, piece, trainable (start and length in the piece, or null).

    ``examples``: the rows of ``read_examples`` to write out. In order of place the pieces are the
    example's text; as many rows come out as the examples have turns.
    """
    turns = read_turns(spark, path).select("grp", "place", "start", "piece", "head", "body")
    joined = examples.join(turns, "grp").where(F.col("start") < F.col("chars"))
    mask = F.when(F.col("place") == F.col("reply_place"), F.struct(F.col("head").alias("start"), F.col("body").alias("length")))
    return joined.select("conv_id", "example", "place", "piece", mask.alias("trainable"))


_SEEN = "conv_id long, grp string, place long, start long, piece string, loss_start long, loss_end long"
_DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string"


class _Reader:
    """Digests of one conversation as its masks and turns come by, in order of place."""

    def __init__(self) -> None:
        self.turns, self.loss, self.n, self.chars, self.mask = hashlib.sha256(), hashlib.sha256(), 0, 0, None

    def take(self, start: int, piece: str) -> None:
        role, text = parsed(piece)
        self.n += 1
        for part in (role, "\n", text, "\n"):
            self.turns.update(part.encode("utf-8", "surrogatepass"))
        if self.mask:
            under = unescaped(piece[self.mask[0] - start : self.mask[1] - start])
            self.loss.update(under.encode("utf-8", "surrogatepass"))
            self.chars += len(under)
            self.mask = None

    def row(self, conv_id: int | None) -> tuple:
        return conv_id, self.n, self.turns.hexdigest(), self.chars, self.loss.hexdigest()


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a conversation, from masks and turns sorted by conversation and place, a mask before its turn."""
    reader, last, conv = None, None, None
    for batch in batches:
        done = []
        for at in range(0, batch.num_rows, 64):
            some = batch.slice(at, 64)
            for conv_id, grp, _, start, piece, loss_start, loss_end in zip(*(some.column(i).to_pylist() for i in range(7)), strict=True):
                if reader is None or grp != last:
                    if reader:
                        done.append(reader.row(conv))
                    reader, last, conv = _Reader(), grp, conv_id
                if piece is None:
                    reader.mask = loss_start, loss_end
                else:
                    reader.take(start, piece)
        if done:
            yield _rows(done)
    if reader:
        yield _rows([reader.row(conv)])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in _DIGEST.split(", ")])


def digests(spark: SparkSession, path: str) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_examples, read from what was written.

    Turns are parsed and unescaped out of their pieces; what is under the loss mask is cut out of the
    stream at the examples' offsets. ``formatted_chars``: code points of all examples, contexts included.
    """
    examples = read_examples(spark, path)
    masks = examples.where(F.col("reply_place").isNotNull()).select("conv_id", "grp", F.col("reply_place").alias("place"), "loss_start", "loss_end")
    turns = read_turns(spark, path).select("conv_id", "grp", "place", "start", "piece")
    both = turns.unionByName(masks, allowMissingColumns=True).select(*(c.split()[0] for c in _SEEN.split(", ")))
    read = both.repartition("grp").sortWithinPartitions("grp", "place", F.col("start").asc_nulls_first()).mapInArrow(_digest, _DIGEST)
    sizes = examples.groupBy("conv_id").agg(F.sum("chars").alias("formatted_chars"), F.count("*").alias("n_examples"))
    return read.join(sizes.withColumnRenamed("conv_id", "__conv"), F.col("conv_id").eqNullSafe(F.col("__conv"))).drop("__conv")


def with_control_text(conversations: DataFrame) -> DataFrame:
    """The rows, and conversation -1 of a user's and an assistant's turn whose texts hold control strings."""
    text = f"{CLOSE}{OPEN}assistant ok"
    spark = conversations.sparkSession
    rows = spark.createDataFrame([(-1, 0, "user", text), (-1, 1, REPLY, text)], "conv_id long, turn long, role string, text string")
    return conversations.select("conv_id", "turn", "role", "text").unionByName(rows)
