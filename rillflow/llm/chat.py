r"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context, and only that reply is trainable.
A turn is written ``<s>[INST]role[/INST]text</s>``. Inside roles and texts a backslash goes before every backslash and
into every control string after its first character, so that no control string is left and parse() gets the turn back.
Turns after a conversation's last reply (all turns, if it has none) make one more example without a target, so that no
turn is lost.

Defined results: rows are ordered by turn, then role, then text, nulls first; repeated rows are turns of their own; null
roles and texts count as empty; rows with a null conv_id make one conversation with that null; an empty table gives no
rows. Other columns are not read, so their names cannot clash. Whatever its length, a text is written whole.

A conversation is one task's: every example holds all turns before it, so a worker needs the formatted turns, whose total
is quadratic in their number by definition. It is streamed turn by turn, never held as rows, and contexts are made one at a
time. Only the turns are shuffled; the examples are not.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, parts, table

CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]")
_ESCAPE = re.compile("|".join(map(re.escape, ("\\", *CONTROLS))))
_TURN = re.compile(r"<s>\[INST\](.*?)\[/INST\](.*?)</s>", re.DOTALL)
_BACK = re.compile(r"\\(.)", re.DOTALL)
#: Characters of formatted text in an output batch.
BATCH_CHARS = 1 << 22


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _BACK.sub(r"\1", text) if "\\" in text else text


def format_turn(role: str | None, text: str | None) -> str:
    return f"<s>[INST]{escape(role or '')}[/INST]{escape(text or '')}</s>"


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) of each turn of a formatted string."""
    return [(unescape(a), unescape(b)) for a, b in _TURN.findall(formatted)]


def expand(turns: Iterator[tuple[int | None, str | None, str | None]]) -> Iterator[dict]:
    """Examples of the (conv_id, role, text) rows of one task, which hold each conversation's turns in order."""
    unset = object()
    conv, done, tail, n = unset, [], 0, 0

    def rest():
        if tail:
            text = "".join(done)
            yield {"conv_id": conv, "example": n, "n_turns": len(done), "n_new": tail, "formatted": text, "target_start": len(text), "target_end": len(text), "has_target": False}

    for c, role, text in turns:
        if c != conv or conv is unset:
            yield from rest()
            conv, done, tail, n = c, [], 0, 0
        body = format_turn(role, text)
        done.append(body)
        tail += 1
        if role == "assistant":
            whole = "".join(done)
            end = len(whole) - len("</s>")
            yield {"conv_id": conv, "example": n, "n_turns": len(done), "n_new": tail, "formatted": whole, "target_start": end - len(escape(text or "")), "target_end": end, "has_target": True}
            tail, n = 0, n + 1
    if conv is not unset:
        yield from rest()


_SCHEMA = "conv_id long, example long, n_turns long, n_new long, formatted string, target_start long, target_end long, has_target boolean"


def examples(conversations: DataFrame) -> DataFrame:
    """conv_id, example (from 0 in a conversation), n_turns, n_new (turns that no earlier example has), formatted, target_start, target_end (code points; the loss mask), has_target."""
    ordered = conversations.select("conv_id", "turn", "role", "text").repartition(parts(conversations.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches):
        out, chars = [], 0
        for e in expand((c, r, t) for b in batches for c, r, t in zip(b["conv_id"], b["role"], b["text"])):
            out.append(e)
            chars += len(e["formatted"])
            if chars > BATCH_CHARS or len(out) >= 4096:
                yield {k: [x[k] for x in out] for k in out[0]}
                out, chars = [], 0
        if out:
            yield {k: [x[k] for x in out] for k in out[0]}

    return map_batches(ordered, run, _SCHEMA)


def read_back(made: DataFrame, in_order: bool = False) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, from the formatted strings and loss masks alone.

    in_order: a task's rows come by conversation and example already, as examples() makes them, so nothing is moved again."""
    ordered = made if in_order else made.repartition(parts(made.sparkSession), "conv_id").sortWithinPartitions("conv_id", "example")

    def run(batches):
        unset = object()
        conv, out = unset, {k: [] for k in ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")}
        turns = loss = None
        n = chars = total = 0

        def close():
            for k, v in zip(out, (conv, n, turns.hexdigest(), chars, loss.hexdigest(), total)):
                out[k].append(v)

        for b in batches:
            for c, new, text, start, end in zip(b["conv_id"], b["n_new"], b["formatted"], b["target_start"], b["target_end"]):
                if c != conv or conv is unset:
                    if conv is not unset:
                        close()
                    conv, turns, loss, n, chars, total = c, hashlib.sha256(), hashlib.sha256(), 0, 0, 0
                got = parse(text)
                for role, body in got[len(got) - new :]:
                    turns.update(f"{role}\n{body}\n".encode())
                n = len(got)
                target = unescape(text[start:end])
                loss.update(target.encode())
                chars += len(target)
                total += len(text)
            if len(out["conv_id"]) >= 4096:
                yield out
                out = {k: [] for k in out}
        if conv is not unset:
            close()
        if out["conv_id"]:
            yield out

    return map_batches(ordered, run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    return read_back(examples(rows.unionByName(own)), in_order=True)


# A turn is 20 characters longer than its escaped role and text; a conversation has one example for each reply, and one more
# where other turns follow the last reply.
OP3_SQL = r"""
WITH rows_ AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (
  SELECT conv_id, role IS NOT DISTINCT FROM 'assistant' AS reply, coalesce(role, '') AS r, coalesce(text, '') AS x,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS n FROM rows_),
f AS (SELECT *, 20 + length(r) + length(x) + len(regexp_extract_all(r || chr(10) || x, '\\|</?s>|\[/?INST\]')) AS size FROM t),
c AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY n) AS done, n = max(n) OVER (PARTITION BY conv_id) AS ends FROM f)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || x || chr(10), '' ORDER BY n)) AS turns_sha256,
  coalesce(sum(length(x)) FILTER (reply), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(x, '' ORDER BY n) FILTER (reply), '')) AS loss_sha256,
  coalesce(sum(done) FILTER (reply OR ends), 0)::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""
