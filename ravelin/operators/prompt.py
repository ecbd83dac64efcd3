"""Prompts: bounded history, context in rank order, messages, answers and event frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ravelin.config import DEFAULT, NOT_FOUND
from ravelin.functions.text import trimmed

SYSTEM = (
    "Answer from the context below and from nothing else. If the context does not hold the answer, say so. "
    "Keep to the point."
)


def recent(conversations: DataFrame, n: int = DEFAULT.history_messages) -> DataFrame:
    """The last ``n`` messages of each conversation (conv_id, turn, role, text), whatever their roles."""
    latest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return conversations.withColumn("__n", F.row_number().over(latest)).filter(F.col("__n") <= n).drop("__n")


def last_messages(history: Column, n: int = DEFAULT.history_messages) -> Column:
    """The last ``n`` elements of an array, all of a shorter one."""
    kept = F.coalesce(history, F.array().cast("array<struct<role: string, content: string>>"))
    return F.slice(kept, F.greatest(F.size(kept) - (n - 1), F.lit(1)), n)


def context(hits: DataFrame, separator: str = DEFAULT.context_separator) -> DataFrame:
    """(qid, context): the hits' contents (qid, rk, content) joined in rank order."""
    ordered = F.array_sort(F.collect_list(F.struct("rk", "content")))
    return hits.groupBy("qid").agg(F.array_join(F.transform(ordered, lambda x: x["content"]), separator).alias("context"))


def messages(questions: DataFrame) -> DataFrame:
    """(qid, seq, role, content) of questions (qid, question, history, context): the system's
    words, the history, then context and question."""
    one = lambda role, text: F.array(F.struct(F.lit(role).alias("role"), text.alias("content")))
    asked = F.concat(F.lit("Context:\n\n"), F.coalesce("context", F.lit("")), F.lit(DEFAULT.context_separator), F.lit("Question: "), F.col("question"))
    whole = F.concat(one("system", F.lit(SYSTEM)), last_messages(F.col("history")), one("user", asked))
    return questions.select("qid", F.posexplode(whole).alias("seq", "m")).select("qid", "seq", "m.role", "m.content")


def answers(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """(qid, answer, n_sources): the fixed sentence where no hit is left, null where a model is to answer."""
    n = hits.groupBy("qid").agg(F.count("*").alias("n"))
    found = F.coalesce("n", F.lit(0))
    return questions.join(n, "qid", "left").select(
        "qid", F.when(found == 0, F.lit(NOT_FOUND)).alias("answer"), found.cast("long").alias("n_sources")
    )


def valid_questions(requests: DataFrame) -> DataFrame:
    """Requests (body) as JSON -> question and history; blank questions are left out."""
    schema = "question string, history array<struct<role: string, content: string>>"
    r = requests.withColumn("__r", F.from_json("body", schema))
    empty = F.array().cast("array<struct<role: string, content: string>>")
    rest = [c for c in requests.columns if c != "body"]
    return r.select(*rest, "__r.question", F.coalesce("__r.history", empty).alias("history")).filter(trimmed(F.col("question")) != "")


def frames(cited: DataFrame, tokens: DataFrame) -> DataFrame:
    """(qid, seq, frame): server-sent events: the sources first, then each token, then the end.

    ``cited`` has (qid, rk, title, source, score), ``tokens`` (qid, pos, token).
    """
    source = F.struct("title", "source", "score")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rk", source.alias("s")))), lambda x: x["s"])
    event = lambda body: F.concat(F.lit("data: "), body, F.lit("\n\n"))
    first = cited.groupBy("qid").agg(ordered.alias("sources")).select(
        "qid", F.lit(0).cast("long").alias("seq"), event(F.to_json(F.struct(F.lit("sources").alias("type"), "sources"))).alias("frame")
    )
    middle = tokens.select(
        "qid", (F.col("pos") + 1).cast("long").alias("seq"), event(F.to_json(F.struct(F.lit("token").alias("type"), "token"))).alias("frame")
    )
    last = tokens.groupBy("qid").agg((F.max("pos") + 2).cast("long").alias("seq")).select("qid", "seq", F.lit("data: [DONE]\n\n").alias("frame"))
    return first.unionByName(middle).unionByName(last)


def folded(events: DataFrame) -> DataFrame:
    """(qid, answer): tokens of ``frames`` put together again; all but token frames are passed over."""
    body = F.from_json(F.substring(F.trim(F.regexp_replace("frame", r"\n", "")), 7, 1 << 30), "type string, token string")
    rows = events.filter(F.col("frame").startswith("data: {")).select("qid", "seq", body.alias("b")).filter("b.type = 'token'")
    ordered = F.array_sort(F.collect_list(F.struct("seq", F.col("b.token").alias("t"))))
    return rows.groupBy("qid").agg(F.array_join(F.transform(ordered, lambda x: x["t"]), "").alias("answer"))
