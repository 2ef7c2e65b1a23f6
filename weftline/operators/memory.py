"""Conversation stores as queries: memories without repeats, context for a reply, tool calls, shared copies, wire events."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from weftline.functions.messages import filled, message_role
from weftline.operators.blocks import Best


class Held:
    """What one user's memory holds, oldest first: key to (last, text, accesses)."""

    def __init__(self, most: int, rows: list[tuple] = ()):
        self.most = most
        self.rows = OrderedDict((first, (last, text, n)) for first, last, text, n in rows)

    def add(self, at, text: str) -> None:
        """Take in an entry: an access of the oldest that it repeats (an equal one before others), or a new one, for which the oldest may go."""
        low, held = text.lower(), self.rows
        same = next((k for k, (_, t, _) in held.items() if t.lower() == low), None)
        if same is None:
            same = next((k for k, (_, t, _) in held.items() if (low in t.lower() or t.lower() in low) and abs(len(t) - len(low)) < 0.5 * len(low)), None)
        if same is not None:
            held[same] = (at, held[same][1], held[same][2] + 1)
            return
        held[at] = (at, text, 0)
        if len(held) > self.most:
            held.popitem(last=False)

    def tuples(self) -> list[tuple]:
        return [(first, last, text, n) for first, (last, text, n) in self.rows.items()]


def remembered(log: DataFrame, user: str, seq: str, content: str, most: int = 100) -> DataFrame:
    """(user, first_seq, last_seq, content, accesses): what each user's memory holds after all entries of ``log`` in order.

    An entry that equals a held one (in lower case), or holds it or is held by it while their lengths differ by less than
    half of its own, counts as an access of that one, the oldest of several. Others are added; over ``most`` the oldest
    goes. Each entry depends on what is held by then, so a user's rows are walked in order, sorted by Spark; what a task
    keeps is one user's ``most`` entries. Entries without a user or a text are left out; an empty log gives an empty table.
    """
    kinds = dict(log.dtypes)
    schema = f"user {kinds[user]}, first_seq {kinds[seq]}, last_seq {kinds[seq]}, content string, accesses long"

    def rows(owner, held: Held) -> pd.DataFrame:
        return pd.DataFrame([(owner, *x) for x in held.tuples()], columns=["user", "first_seq", "last_seq", "content", "accesses"])

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        owner, held = None, Held(most)
        for batch in batches:
            for who, at, text in batch.itertuples(index=False, name=None):
                if who != owner:
                    if held.rows:
                        yield rows(owner, held)
                    owner, held = who, Held(most)
                held.add(at, text)
        if held.rows:
            yield rows(owner, held)

    named = log.select(F.col(user).alias("user"), F.col(seq).alias("seq"), F.col(content).alias("content")).where("user IS NOT NULL AND content <> ''")
    return named.repartition("user").sortWithinPartitions("user", "seq").mapInPandas(walk, schema)


class _Remembering(StatefulProcessor):
    """A user's memory as a list in the state store; each batch tells what the users that it names hold after it."""

    def __init__(self, most: int):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", "first_seq long, last_seq long, content string, accesses long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = Held(self.most, [tuple(r) for r in self.held.get()])
        new = pd.concat(list(rows)).sort_values("seq")
        for at, text in zip(new["seq"].tolist(), new["content"].tolist()):
            held.add(at, text)
        out = held.tuples()
        self.held.put(out)
        yield pd.DataFrame([(key[0], int(new["seq"].max()), *x) for x in out], columns=["user", "as_of", "first_seq", "last_seq", "content", "accesses"])

    def close(self) -> None:
        pass


def remembered_stream(log: DataFrame, user: str, seq: str, content: str, most: int = 100) -> DataFrame:
    """The streaming form of ``remembered``: (user, as_of, first_seq, last_seq, content, accesses) of every user that a batch names, after its entries.

    ``seq`` is a whole number that grows from batch to batch; entries of one batch are put in order by it. A user's
    state is ``most`` entries, the oldest going as in the batch form; the rows of the largest ``as_of`` of a user are
    what the batch form has. Needs a state store that holds lists (RocksDB).
    """
    kinds = dict(log.dtypes)
    named = log.select(F.col(user).alias("user"), F.col(seq).cast("long").alias("seq"), F.col(content).alias("content")).where("user IS NOT NULL AND content <> ''")
    schema = f"user {kinds[user]}, as_of long, first_seq long, last_seq long, content string, accesses long"
    return named.groupBy("user").transformWithStateInPandas(_Remembering(most), schema, "update", "none")


#: Memories of a user that a task takes at once.
RECALL_BLOCK = 4096


def recalled(memories: DataFrame, queries: DataFrame, k: int, keyword: float = 0.3, bonus: float = 0.01, most_accesses: int = 10, digits: int = 9) -> DataFrame:
    """(user, query_id, id, score, rank): the ``k`` best of a user's ``memories`` (user, id, content, vector, accesses) for each of the user's ``queries`` (user, query_id, query, vector).

    The score is ``keyword`` times the share of the query's words (of two letters or more) that the content holds, plus
    the rest times the cosine, plus ``bonus`` for each access up to ``most_accesses``. Ties go to the smaller id. A
    missing vector, or one of zeros, has no part in the cosine. A user's memories and queries are dealt to blocks by
    their number, and each two blocks meet in a task of their own, which keeps its ``k`` best of each query; so a user
    may hold any part of the rows. Ids are whole numbers. Rows without a user take no part.
    """
    blocks = lambda df, name: df.where("user IS NOT NULL").groupBy("user").agg(F.ceil(F.count(F.lit(1)) / RECALL_BLOCK).cast("int").alias(name))
    sizes = blocks(memories, "__down").join(blocks(queries, "__across"), "user")
    own = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    held = memories.select("user", "id", "content", "vector", "accesses").join(sizes, "user").withColumn("row", own("id", "__down")).withColumn("part", each("__across")).drop("__down", "__across")
    # Both sides may come from one table, so the columns of one get names of their own.
    asked = queries.select("user", "query_id", "query", "vector").join(sizes, "user").withColumn("part", own("query_id", "__across")).withColumn("row", each("__down")).drop("__down", "__across")
    kinds = dict(memories.dtypes)

    def unit(column: pa.ChunkedArray, width: int) -> np.ndarray:
        out = np.zeros((len(column), width))
        for i, x in enumerate(column.to_pylist()):
            if x is not None and len(x) == width:
                out[i] = x
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        left, names = left.rename_columns([c.removeprefix("__") for c in left.column_names]), ["user", "query_id", "id", "score"]
        if not left.num_rows or not right.num_rows:
            return pa.table([left.column("user")[:0], left.column("query_id")[:0], right.column("id")[:0], pa.array([], pa.float64())], names)
        width = max([len(x) for x in left.column("vector").to_pylist() if x is not None] or [0])
        rows, ids = unit(right.column("vector"), width), right.column("id").to_numpy()
        content = [(x or "").lower() for x in right.column("content").to_pylist()]
        extra = np.minimum(right.column("accesses").fill_null(0).to_numpy(), most_accesses) * bonus
        parts = []
        for at in range(0, left.num_rows, 256):
            part = left.slice(at, 256)
            cosine = unit(part.column("vector"), width) @ rows.T
            share = np.zeros_like(cosine)
            for i, query in enumerate(part.column("query").to_pylist()):
                words = [w for w in (query or "").lower().split() if len(w) > 1]
                if words:
                    share[i] = [sum(w in c for w in words) / len(words) for c in content]
            best = Best(part.num_rows, k)
            best.add(np.round(keyword * share + (1 - keyword) * cosine + extra, digits) + 0.0, ids)
            q, score, found = best.held
            parts.append(pa.table([part.column("user").take(pa.array(q)), part.column("query_id").take(pa.array(q)), pa.array(found), pa.array(score)], names))
        return pa.concat_tables(parts)

    by = ["user", "row", "part"]
    schema = f"user {kinds['user']}, query_id {dict(queries.dtypes)['query_id']}, id {kinds['id']}, score double"
    hits = asked.toDF(*[f"__{c}" for c in asked.columns]).groupBy(*[f"__{c}" for c in by]).cogroup(held.groupBy(*by)).applyInArrow(meet, schema)
    place = F.row_number().over(Window.partitionBy("user", "query_id").orderBy(F.desc("score"), "id"))
    return hits.withColumn("rank", place).where(F.col("rank") <= k)


def accessed(memories: DataFrame, hits: DataFrame, least: float = 0.1) -> DataFrame:
    """``memories`` with one more access for each query that gave a row a score over ``least`` (``hits``: user, id, score)."""
    more = hits.where(F.col("score") > least).groupBy("user", "id").agg(F.count(F.lit(1)).alias("__more"))
    return memories.join(more, ["user", "id"], "left").withColumn("accesses", F.coalesce("accesses", F.lit(0)) + F.coalesce("__more", F.lit(0))).select(*memories.columns)


def memory_context(profile: Column, memories: Column, recent: Column, top: int = 5, least: float = 0.15, most: int = 3000) -> Column:
    """The text that a reply is given: facts (array of struct(field, value)), the best of memories (struct(score, type, content), best first) and recent turns.

    Parts without content are left out; a longer text is cut and marked.
    """
    lines = lambda rows, line: F.array_join(F.transform(rows, line), "\n")
    block = lambda head, body: F.when(F.coalesce(body, F.lit("")) != "", F.concat(F.lit(f"[{head}]\n"), body))
    good = F.filter(F.slice(memories, 1, top), lambda m: m["score"] > least)
    text = F.concat_ws(
        "\n\n",
        block("用户信息", lines(profile, lambda p: F.concat(F.lit("- "), p["field"], F.lit(": "), p["value"]))),
        block("相关记忆", lines(good, lambda m: F.concat(F.lit("- ["), m["type"], F.lit("] "), m["content"]))),
        block("近期对话", recent),
    )
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("\n..."))).otherwise(text)


def tool_calls(fragments: DataFrame, stream: str = "stream_id") -> DataFrame:
    """(stream, index, id, name, arguments) of calls that arrive in fragments (stream, seq, index, id, name, arguments).

    Arguments are joined in order, the last id and name that are given count, calls without a name go, and arguments that
    are not JSON become ``{}``. A call's fragments are what one reply holds, so they are gathered in one row.
    """
    parts = F.array_sort(F.collect_list(F.struct("seq", F.coalesce("arguments", F.lit("")).alias("a"))))
    last = lambda c: F.max_by(c, F.when(F.col(c) != "", F.col("seq"))).alias(c)
    calls = fragments.groupBy(stream, F.coalesce("index", F.lit(0)).alias("index")).agg(last("id"), last("name"), F.array_join(F.transform(parts, lambda p: p["a"]), "").alias("arguments"))
    whole = F.when(F.try_parse_json("arguments").isNotNull(), F.col("arguments")).otherwise("{}")
    return calls.where("name <> ''").select(stream, "index", "id", "name", whole.alias("arguments"))


def shared_copy(turns: DataFrame, conversation: str, turn: str, role: str, text: str, message_id: str | None = None, most: int = 200) -> DataFrame:
    """(conversation, turn, role, text): the first ``most`` turns with a text, without the welcome, roles as user or model."""
    said = turns.where(F.trim(F.col(text)) != "")
    if message_id:
        said = said.where(F.coalesce(F.col(message_id), F.lit("")) != "welcome")
    place = F.row_number().over(Window.partitionBy(conversation).orderBy(turn))
    kept = said.withColumn("__place", place).where(F.col("__place") <= most)
    return kept.select(conversation, turn, F.when(F.col(role) == "user", "user").otherwise("model").alias("role"), text)


def wire_event(kind: Column, done: Column, content: Column, name: Column, summary: Column, millis: Column) -> Column:
    """The JSON that an event (intent, sources, tool_call, tool_result, content) is sent as; retrieval and unknown ones are not sent."""
    result = F.struct(F.struct(name.alias("name"), filled(summary, content).alias("content"), millis.alias("durationMs")).alias("tool_result"))
    one = lambda key: F.to_json(F.struct(content.alias(key)))
    return (
        F.when(kind == "intent", one("intent")).when(kind == "sources", one("sources")).when(kind == "tool_call", one("tool_call")).when(kind == "tool_result", F.to_json(result))
        .when((kind == "content") & done, F.lit("[DONE]")).when(kind == "content", F.to_json(F.struct(F.coalesce(content, F.lit("")).alias("content"))))
    )


def normalised_turns(turns: DataFrame, role: str, *fields: str) -> DataFrame:
    """``turns`` with ``role`` as user or model and ``content`` from the first of ``fields`` that is there."""
    return turns.withColumn(role, message_role(F.col(role))).withColumn("content", F.trim(F.coalesce(*[F.col(f) for f in fields], F.lit(""))))


def scored_by_people(results: DataFrame, scores: DataFrame, key: str) -> DataFrame:
    """``results`` with ``human_score`` (null for none or 0) and ``comment`` (empty for none) of ``scores`` (key, score, comment), one row each."""
    own = scores.select(key, F.nullif(F.col("score").cast("double"), F.lit(0.0)).alias("human_score"), F.col("comment").alias("__comment"))
    return results.join(own, key, "left").withColumn("comment", F.coalesce("__comment", F.lit(""))).drop("__comment")
