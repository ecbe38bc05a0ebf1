"""Conversations rebuilt from message rows, read as an event log.

Every row is an event about a message: it is created, delivered again, edited or
deleted. The events of one message are folded by version into its final state,
and what a delete ends is gone. What remains are the turns; a fold over the
ordered turns then tells which sessions are unfit.

A table of plain messages is a log without edits: a row creates its message, and
rows with the same speaker, content and time in a session, or the same id again,
deliver it again. A table that names a kind and a version of its rows is folded
by those.

Long sessions are split at quantiles of their place in order into pieces of about
the same number of rows, which are folded apart and put together again, so no
session has to fit into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from normlake.plans.runtime import MIN_HOT_ROWS, hot_keys, stored

#: Spellings of the speaker, after trimming and lower-casing.
SPEAKERS = {
    "user": "user",
    "human": "user",
    "assistant": "assistant",
    "model": "assistant",
    "ai": "assistant",
    "system": "system",
    "tool": "tool",
    "function": "tool",
}
#: Kinds of events. Fixed values.
CREATE, RETRY, EDIT, DELETE = "create", "retry", "edit", "delete"
#: Rows of a piece of a hot session, about.
PIECE_ROWS = 50_000


def speaker(role: Column) -> Column:
    """user, assistant, system, tool, or 'unreadable' for null and anything else."""
    known = F.create_map(*[F.lit(x) for pair in SPEAKERS.items() for x in pair])
    plain = F.lower(F.regexp_replace(role, r"(?U)^\s+|\s+$", ""))
    return F.coalesce(known[plain], F.lit("unreadable"))


def events(messages: DataFrame, kind: str | None = None, version: str | None = None, message: str = "id") -> DataFrame:
    """The log of messages: session_id, message_id, version, kind, at, speaker, content_hash, content_length, blank, calls.

    Without the name of a kind column every row creates its message, and a row
    is its own version. Rows without session are no events. A kind that is null
    or none of create, retry, edit and delete counts as a create; a null version
    is the earliest. Content is told apart by hash and length.
    """
    content = F.coalesce(F.col("content"), F.lit(""))
    known = F.lower(F.col(kind)) if kind else F.lit(CREATE)
    return messages.where(F.col("session_id").isNotNull()).select(
        "session_id",
        F.col(message).alias("message_id"),
        (F.col(version).cast("long") if version else F.lit(0).cast("long")).alias("version"),
        F.when(known.isin(RETRY, EDIT, DELETE), known).otherwise(CREATE).alias("kind"),
        F.col("created_at").alias("at"),
        speaker(F.col("role")).alias("speaker"),
        F.xxhash64(content).alias("content_hash"),
        F.length(content).alias("content_length"),
        content.rlike(r"(?U)^\s*$").alias("blank"),
        F.col("tool_calls_json").isNotNull().alias("calls"),
    )


def fold_versions(log: DataFrame) -> DataFrame:
    """One row a message that still stands: session_id, at, message_id, speaker, is_turn and what tells its content.

    The events of a message id are folded in the order of version. Its place is
    that of its first event. A create or an edit sets speaker and content, and a
    retry does where there is none yet: delivered again it changes nothing. The
    message is gone if its last event but for retries is a delete; an edit that
    follows a delete brings it back. Of several equal versions the greatest
    content hash counts. Both steps are combined map-side.
    """
    state = F.struct("speaker", "content_hash", "content_length", "blank", "calls")
    # A retry goes before everything else of its version, and before the first create it has no weight.
    weight = F.struct((F.col("kind") != RETRY).cast("int").alias("own"), F.col("version"), (F.col("kind") == DELETE).cast("int").alias("gone"), "content_hash", "calls")
    text = F.when(F.col("kind") != DELETE, weight)
    folded = log.groupBy("session_id", "message_id").agg(
        F.min_by("at", F.struct("version", "at")).alias("at"),
        F.max_by("kind", weight).alias("kind"),
        F.max_by(state, text).alias("s"),
    )
    return folded.where((F.col("kind") != DELETE) & F.col("s").isNotNull()).select("session_id", "at", "message_id", "s.*")


def fold_deliveries(messages: DataFrame, kind: str | None = None, version: str | None = None, message: str = "id") -> DataFrame:
    """One row a message: session_id, at, message_id, speaker, is_turn.

    First the events of each message id are folded by version, then messages
    with the same speaker, content and time in a session: they are one message
    that was delivered under several ids, and the smallest id stays. A missing
    time sorts first.
    """
    standing = fold_versions(events(messages, kind, version, message))
    folded = standing.groupBy("session_id", "at", "speaker", "content_hash", "content_length", "blank").agg(
        F.min("message_id").alias("message_id"), F.max("calls").alias("calls")
    )
    turn = F.col("speaker").isin("user", "assistant") & ~F.col("blank") & ~((F.col("speaker") == "assistant") & F.col("calls"))
    return folded.select("session_id", "at", "message_id", "speaker", turn.alias("is_turn"))


def with_piece(folded: DataFrame, min_hot_rows: int = MIN_HOT_ROWS) -> DataFrame:
    """Add `piece`: 0 for ordinary sessions, in hot ones the number of the slice of (time, id), in order.

    A hot session gets pieces in proportion to its rows. Rows of one time are
    told apart by id, so that they, too, can be split.
    """
    hot = hot_keys(folded, "session_id", min_hot_rows)
    if not hot:
        return folded.withColumn("piece", F.lit(0))
    kind = folded.schema["session_id"].dataType.simpleString()
    listed = F.broadcast(folded.sparkSession.createDataFrame([(k,) for k in hot], f"session_id {kind}"))
    own = folded.join(listed, "session_id", "left_semi")
    at = F.coalesce(F.unix_micros(F.col("at").cast("timestamp")), F.lit(-(1 << 62)).cast("long"))
    # One sort by range over all hot sessions: its partitions are the pieces, bounded by place and not by session.
    n = max(1, -(-own.count() // min(PIECE_ROWS, min_hot_rows)))
    split = own.withColumn("_at", at).repartitionByRange(n, "session_id", "_at", "message_id").withColumn("piece", F.spark_partition_id() + 1).drop("_at")
    # Written down, since a second evaluation might cut elsewhere.
    split = stored(split)
    return folded.join(listed, "session_id", "left_anti").withColumn("piece", F.lit(0)).unionByName(split)


def fold_sessions(pieces: DataFrame) -> DataFrame:
    """One row a session: what its ordered turns show.

    turns, unreadable, first (speaker of the first turn), doubled (two assistant
    turns in a row), unanswered (a user turn without an assistant turn next).
    """
    order = Window.partitionBy("session_id", "piece").orderBy(F.col("at").asc_nulls_first(), "message_id")
    turns = pieces.where("is_turn").withColumn("before", F.lag("speaker").over(order))
    position = F.struct("at", "message_id")
    per_piece = turns.groupBy("session_id", "piece").agg(
        F.count(F.lit(1)).alias("turns"),
        F.min_by("speaker", position).alias("first"),
        F.max_by("speaker", position).alias("last"),
        F.max((F.col("speaker") == "assistant") & (F.col("before") == "assistant")).alias("doubled"),
        F.max((F.col("speaker") == "user") & (F.col("before") == "user")).alias("unanswered"),
    )
    # A row for every PIECE_ROWS rows of a hot session from here on.
    chain = Window.partitionBy("session_id").orderBy("piece")
    joined = per_piece.withColumn("prior", F.lag("last").over(chain)).withColumn("latest", F.lead("last").over(chain).isNull())
    per_session = joined.groupBy("session_id").agg(
        F.sum("turns").alias("turns"),
        F.min_by("first", "piece").alias("first"),
        F.max(F.coalesce("doubled", F.lit(False)) | F.coalesce((F.col("prior") == "assistant") & (F.col("first") == "assistant"), F.lit(False))).alias("doubled"),
        F.max(
            F.coalesce("unanswered", F.lit(False))
            | F.coalesce((F.col("prior") == "user") & (F.col("first") == "user"), F.lit(False))
            | (F.col("latest") & (F.col("last") == "user"))
        ).alias("unanswered"),
    )
    seen = pieces.groupBy("session_id").agg(F.max(F.col("speaker") == "unreadable").alias("unreadable"))
    return seen.join(per_session, "session_id", "left")


def unfit_sessions(messages: DataFrame, min_hot_rows: int = MIN_HOT_ROWS, **log: str) -> DataFrame:
    """(session_id, defect) of sessions to drop; the first of empty, broken, no_reply that holds.

    Null, blank and unreadable values have the meaning given in fold_deliveries;
    an empty table gives no rows; other columns of the input are ignored. `log`
    names the columns of a log with edits (kind, version, message). A session of
    which every message was deleted is gone and not unfit.
    """
    return _unfit(with_piece(fold_deliveries(messages, **log), min_hot_rows))


def _unfit(pieces: DataFrame) -> DataFrame:
    state = fold_sessions(pieces)
    defect = (
        F.when(F.col("turns").isNull(), "empty")
        .when(F.col("unreadable") | (F.col("first") != "user") | F.col("doubled"), "broken")
        .when(F.col("unanswered"), "no_reply")
    )
    return state.select("session_id", defect.alias("defect")).where("defect is not null")


def conversations(messages: DataFrame, min_hot_rows: int = MIN_HOT_ROWS, **log: str) -> DataFrame:
    """(session_id, turn, speaker, message_id) of the surviving sessions, turn from 1 in order."""
    pieces = with_piece(fold_deliveries(messages, **log), min_hot_rows)
    turns = pieces.where("is_turn")
    sizes = turns.groupBy("session_id", "piece").agg(F.count(F.lit(1)).alias("n"))
    chain = Window.partitionBy("session_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("session_id", "piece", F.coalesce(F.sum("n").over(chain), F.lit(0)).alias("offset"))
    order = Window.partitionBy("session_id", "piece").orderBy(F.col("at").asc_nulls_first(), "message_id")
    numbered = turns.withColumn("place", F.row_number().over(order)).join(offsets, ["session_id", "piece"])
    unfit = _unfit(pieces)
    return numbered.join(unfit, "session_id", "left_anti").select("session_id", (F.col("offset") + F.col("place")).alias("turn"), "speaker", "message_id")
