"""Conversation repair against a search over all plans."""

import functools
import hashlib
import random
import re
import zlib

import pandas as pd
import pytest
from pyspark.sql import functions as F

from learntrace.llm import conversations, queries
from tests.conftest import SF

WS = " \t\n\x0b\x0c\r"


def searched(rows):
    """The report of rows (turn, role, text) in order: every plan's roles are checked by a pattern."""
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.strip(WS)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))

    @functools.cache
    def best(i, roles):
        found = [(0, "", ())] if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles) else []

        def take(cost, letter, role, text, at):
            if role[:1] and re.fullmatch("s?(ua)*u?", roles + role[:1]) and (rest := best(at, roles + role[:1])):
                found.append((cost + rest[0], letter + rest[1], ((role, text), *rest[2])))

        if len(roles) < 2 * len(rows) + 4:
            for role in ("user", "assistant"):
                take(5, "I", role, "", i)
        if i < len(rows):
            _, role, text = rows[i]
            if rest := best(i + 1, roles):
                found.append((2 + rest[0], "D" + rest[1], rest[2]))
            if faults[i] not in ("blank", "duplicate"):
                more = 5 if faults[i] == "truncated" else 0
                take(more, "K", role, text, i + 1)
                for other in ("user", "assistant"):
                    take(1 + more, "R", other, text, i + 1)
        return min(found, default=None)

    cost, audit, repaired = best(0, "")
    turns = [t for t, _, _ in rows if t is not None]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()
    return max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest


def broken(conv, rows):
    space = lambda v: " " if v is None else v
    out = []
    for turn, role, text in rows:
        d = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        role, text = "user" if d == 4 else space(role), "" if d == 1 else re.sub("[.!?]", "", space(text)) if d == 2 else space(text)
        out += [(turn, role, text)] * (0 if d == 0 else 2 if d == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def drawn(seed, n=120):
    draw = random.Random(seed)
    roles, texts = ["user", "user", "assistant", "assistant", "system", "tool", None, ""], ["hi.", "yo!", "no", "a? ", "", " \n", None, "x.", "y.", "z."]
    return {c: [(draw.choice([None, *range(8)]), draw.choice(roles), draw.choice(texts)) for _ in range(draw.randint(1, 6))] for c in [*range(n), None, 2**60 + 1]}


def table(spark, convs):
    return spark.createDataFrame([(c, *r, "kept") for c, rows in convs.items() for r in rows], "conv_id long, turn long, role string, text string, plan string")


@pytest.mark.parametrize("seed", [1, 2])
def test_awkward_conversations(spark, seed):
    convs = drawn(seed)
    got = {r["conv_id"]: tuple(r)[1:] for r in conversations.conversation_digest(table(spark, convs)).collect()}
    assert got == {c: searched(broken(c, rows)) for c, rows in convs.items()}


def test_query(spark):
    convs = {}
    for r in pd.read_parquet(f"{SF}/conversations.parquet").itertuples():
        convs.setdefault(r.conv_id, []).append((r.turn, r.role, r.text))
    got = {r["conv_id"]: tuple(r)[1:] for r in queries.QUERIES["op12_conversation_repair"](spark, SF).collect()}
    assert got == {c: searched(broken(c, rows)) for c, rows in convs.items()}


def test_repaired_rows_give_the_digest(spark):
    rows = conversations.damaged(conversations.plain_rows(table(spark, drawn(3))))
    digest = {r["conv_id"]: (r["repaired_sha256"], r["audit"]) for r in conversations.repair_report(rows).collect()}
    found = conversations.repaired_rows(rows).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.when(F.col("place").isNotNull(), F.struct("place", "role", "text")))).alias("kept"), F.count("*").alias("n")).collect()
    assert len(found) > 100
    for r in found:
        assert [x["place"] for x in r["kept"]] == list(range(len(r["kept"])))
        assert hashlib.sha256("\n".join(f"{x['role']}:{x['text']}" for x in r["kept"]).encode()).hexdigest() == digest[r["conv_id"]][0]
        assert r["n"] == len(digest[r["conv_id"]][1])


def test_a_giant_conversation_streams_in_batches(spark):
    """One conversation over many Arrow batches: the costs and the state are carried across them."""
    n = 5000
    rows = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("line "), F.col("id").cast("string"), F.lit(".")).alias("text"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "97")
    try:
        whole = conversations.repair_report(conversations.plain_rows(rows)).first()
        hurt = conversations.repair_report(conversations.plain_rows(rows.where("turn <> 2500"))).first()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert whole["audit"] == "K" * n and whole["cost"] == 0
    assert hurt["gaps"] == 1 and hurt["illegal"] == 1 and hurt["cost"] == 2 and hurt["audit"] == "K" * 2499 + "D" + "K" * (n - 2501)
    assert whole["repaired_sha256"] == hashlib.sha256("\n".join(f"{('user', 'assistant')[i % 2]}:line {i}." for i in range(n)).encode()).hexdigest()


def test_empty_and_dropped(spark):
    empty = table(spark, drawn(1)).limit(0)
    assert conversations.conversation_digest(empty).count() == 0
    assert conversations.repaired_rows(conversations.plain_rows(empty)).count() == 0
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    row = conversations.conversation_digest(spark.createDataFrame([(gone, 0, "user", "hi.")], "conv_id long, turn long, role string, text string")).first()
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
