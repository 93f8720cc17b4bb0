"""Weak supervision: reliabilities of voters by expectation-maximisation over vote patterns."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOTES = (-1, 0, 1)


@dataclass
class VoteModel:
    """Two hidden classes, good (1) and bad (0); voters are independent given the class."""

    names: list[str]
    prior: float
    #: chance[voter][class][vote]
    chance: list[dict[int, dict[int, float]]]

    def logit(self, votes: tuple[int, ...]) -> float:
        out = math.log(self.prior / (1 - self.prior))
        for c, v in zip(self.chance, votes):
            out += math.log(c[1][v] / c[0][v])
        return out

    def posterior(self, votes: tuple[int, ...]) -> float:
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, self.logit(votes)))))

    def accuracy(self) -> dict[str, float]:
        """Of each voter, the chance that a vote it casts names the right class."""
        out = {}
        for name, c in zip(self.names, self.chance):
            right = self.prior * c[1][1] + (1 - self.prior) * c[0][-1]
            cast = right + self.prior * c[1][-1] + (1 - self.prior) * c[0][1]
            out[name] = right / cast if cast else 0.5
        return out

    def posterior_column(self) -> Column:
        """The posterior as an expression over the vote columns."""
        total = F.lit(math.log(self.prior / (1 - self.prior)))
        for name, c in zip(self.names, self.chance):
            w = {v: math.log(c[1][v] / c[0][v]) for v in VOTES}
            total = total + F.when(F.col(name) > 0, w[1]).when(F.col(name) < 0, w[-1]).otherwise(w[0])
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def vote_patterns(votes: DataFrame, names: list[str]) -> list[tuple[tuple[int, ...], int]]:
    """Each distinct combination of votes and its rows: at most 3 ** len(names) rows reach the driver."""
    found = votes.groupBy(*names).agg(F.count(F.lit(1)).alias("__n")).collect()
    return sorted((tuple(int(r[n]) for n in names), int(r["__n"])) for r in found)


def fit_votes(patterns: list[tuple[tuple[int, ...], int]], names: list[str], rounds: int = 100, smooth: float = 1.0, prior: VoteModel | None = None, prior_rows: float = 20.0) -> VoteModel:
    """EM from a start in which any vote for bad makes a pattern probably bad.

    Every probability is smoothed by ``smooth`` pseudo-rows, so no vote is ever
    certain and an empty table gives a model that knows nothing. With a ``prior``
    model, EM starts from it, and it counts as ``prior_rows`` rows of each class.
    """
    good = {p: prior.posterior(p) if prior else (0.1 if min(p, default=0) < 0 else 0.95) for p, _ in patterns}
    model = VoteModel(names, 0.5, [{c: dict.fromkeys(VOTES, 1 / 3) for c in (0, 1)} for _ in names])
    for _ in range(rounds):
        weight = {1: smooth, 0: smooth}
        seen = [{c: {v: smooth * (2.0 if (v > 0) == (c == 1) and v else 1.0) for v in VOTES} for c in (0, 1)} for _ in names]
        if prior:
            seen = [{c: {v: prior_rows * x for v, x in own[c].items()} for c in (0, 1)} for own in prior.chance]
        for p, n in patterns:
            for c, share in ((1, good[p]), (0, 1 - good[p])):
                weight[c] += n * share
                for j, v in enumerate(p):
                    seen[j][c][v] += n * share
        chance = [{c: {v: x / sum(s[c].values()) for v, x in s[c].items()} for c in (0, 1)} for s in seen]
        model = VoteModel(names, weight[1] / (weight[0] + weight[1]), chance)
        new = {p: model.posterior(p) for p, _ in patterns}
        moved = max((abs(new[p] - good[p]) for p in new), default=0.0)
        good = new
        if moved < 1e-6:
            break
    return model
