"""What operators leave on disk and hold in memory."""

from pathlib import Path

import numpy as np
import pytest

from corpuscle.llm import line_dedup, lm_score, simhash
from corpuscle.llm.common import materialize, shared_dir

from .samples import prose, table


def tables(spark):
    at = Path(shared_dir(spark).removeprefix("file:")) / "corpuscle"
    return set(at.iterdir()) if at.exists() else set()


def shuffled(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString(" ").split()
    return {b for b in blocks if b.startswith("shuffle_")}


ROWS = [(i, f"{prose(i // 2, 80)}\nA line that many texts share\n{prose(1000 + i, 12)}") for i in range(60)]


@pytest.mark.parametrize("operator, left", [(simhash.keep_one, 1), (line_dedup.drop_repeated_lines, 2)])
def test_tables_between_go_when_used(spark, operator, left):
    docs, before = table(spark, ROWS, extra=False), tables(spark)
    result = operator(docs)
    assert len(tables(spark) - before) == left
    assert result.count() == result.count() > 0


def test_shuffle_files_go_with_what_is_written(spark):
    before = shuffled(spark)
    made = materialize(spark.range(10_000).selectExpr("id % 100 AS k").groupBy("k").count())
    assert not shuffled(spark) - before
    assert made.count() == 100


def test_blocks_are_dealt_in_passes(spark, monkeypatch):
    plan, dealt, members = simhash.BlockPlan.of(5000, 0.8, 0.95), [], simhash._block_members

    def seen(nodes, plan, first, last):
        dealt.append((first, last))
        return members(nodes, plan, first, last)

    docs = table(spark, ROWS, extra=False)
    whole = sorted(r["doc_id"] for r in simhash.keep_one(docs).collect())
    monkeypatch.setattr(simhash, "_block_members", seen)
    monkeypatch.setattr(simhash, "PASS_BLOCKS", 5)
    assert sorted(r["doc_id"] for r in simhash.keep_one(docs).collect()) == whole
    assert max(b - a for a, b in dealt) == 5 and [a for a, _ in dealt[1:]] == [b for _, b in dealt[:-1]]
    assert dealt[0][0] == 0 and dealt[-1][1] == simhash.BlockPlan.of(len(ROWS), 0.8, 0.95).blocks
    bits = np.random.default_rng(1).integers(0, 2, (7, -(-plan.width * plan.blocks // 64) * 64)).astype(np.uint8)
    slow = [[(sum(int(x[k * plan.width + i]) << i for i in range(plan.width)) << 12) + k for k in range(3, 9)] for x in bits]
    assert plan.keys(np.packbits(bits, axis=1, bitorder="little"), 3, 9).tolist() == slow


def test_probes_of_a_long_text_come_in_small_rows(spark, monkeypatch):
    """A page of a file holds a hundred rows, so a row of a whole chunk's probes made pages of a hundred megabytes."""
    rows = [(0, "first"), (1, " ".join(f"w{i * i % 7001}" for i in range(30_000))), (2, "w1 w4 w9")]
    sizes, passes = [], lm_score._answered_by_passes

    def seen(dealt, *more):
        sizes.extend(r[0] for r in dealt.where("pass >= 0").selectExpr("length(h)").collect())
        return passes(dealt, *more)

    monkeypatch.setattr(lm_score, "_answered_by_passes", seen)
    once, many = (
        {r["doc_id"]: round(r["score"], 5) for r in lm_score.score_documents(table(spark, rows), pass_bytes=size, hot_tokens=20).collect()} for size in (1 << 27, 16_000)
    )
    assert once == many and sum(sizes) == 8 * (30_001 + 2 + 4) and max(sizes) <= 8 * 4096


def test_a_worker_holds_the_filters_of_one_pass():
    class Later:
        """Tells what is held when its value is fetched."""

        @property
        def value(self):
            held.append(dict(lm_score._HELD))
            return None, None, None, 12

    held = []
    first, second = (lm_score._Given(key, Later()) for key in "ab")
    assert first.filters() is first.filters() and second.filters()["key"] == "b"
    assert held == [{}, {}]
