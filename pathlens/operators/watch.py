"""Tiers of watched directories under a budget: L0 is watched, L1 is scanned in turn.

Directories: path, tier, watch_cost, last_event, last_scan (seconds), pending
flags. The budget binds all directories together, so decisions are made on the
driver, one batch at a time, over the few rows that ask for a change.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IDLE_SECONDS = 7_200
SEND, BLOCKED, NOT_ELIGIBLE = "send_add", "budget_blocked", "not_eligible"


def watch_cost(dirs: DataFrame, root: str, most: int) -> DataFrame:
    """Directories at or below ``root``, at most ``most``."""
    from pathlens.functions.paths import is_under

    return dirs.where(is_under(F.col("path"), root)).limit(most).agg(F.least(F.count(F.lit(1)), F.lit(most)).alias("watch_cost"))


def hot_candidates(dirs: DataFrame, asked: list[str], roots: list[str], exclude_dirs: list[str] | None = None) -> DataFrame:
    """The asked-for directories that exist, lie under a root and have no excluded component; the roots if none does."""
    from functools import reduce
    from operator import or_

    from pathlens.functions.exclude import excluded
    from pathlens.functions.paths import components, is_under

    path = F.col("path")
    there = dirs.select("path").distinct().where(~excluded(components(path), exclude_dirs))
    found = there.where(path.isin(*asked) & reduce(or_, (is_under(path, r) for r in roots), F.lit(False)))
    return there.where(path.isin(*roots)) if found.isEmpty() else found


def admission(candidates: DataFrame, budget: int, groups: list[str] | None = None) -> DataFrame:
    """(path, watch_cost, admitted): in order of path, each candidate that still fits is admitted.

    One that does not fit uses nothing up, so this is a fold and no running sum.
    Candidates are the hot directories of a configuration, some hundred at most.
    """
    keys = groups or []
    rows = candidates.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("path", F.col("watch_cost").cast("long").alias("watch_cost")))).alias("c"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit("").alias("fits"))

    def step(a: Column, x: Column) -> Column:
        fits = a["used"] + x["watch_cost"] <= budget
        return F.struct((a["used"] + F.when(fits, x["watch_cost"]).otherwise(F.lit(0).cast("long"))).alias("used"), F.concat(a["fits"], F.when(fits, F.lit("1")).otherwise(F.lit("0"))).alias("fits"))

    # one character a candidate is all that the fold carries along
    folded = rows.select(*keys, "c", F.split(F.aggregate("c", start, step, lambda a: a["fits"]), "").alias("fits"))
    return folded.select(*keys, F.explode(F.arrays_zip("c", "fits")).alias("x")).where("x.c IS NOT NULL").select(*keys, "x.c.path", "x.c.watch_cost", (F.col("x.fits") == "1").alias("admitted"))


def report(dirs: DataFrame, budget: int) -> DataFrame:
    """Counts by tier, pending promotions and the share of the budget that is in use."""
    tier = lambda n: F.count_if(F.col("tier") == n).alias(f"{n.lower()}_dirs")
    used = F.coalesce(F.sum(F.when(F.col("tier") == "L0", F.col("watch_cost"))), F.lit(0)).cast("long")
    percent = F.least(F.floor(F.col("watched_dirs") * 100 / budget), F.lit(100)).cast("long") if budget else F.lit(0).cast("long")
    return dirs.agg(*map(tier, ("L0", "L1", "L2", "L3")), F.count_if("promotion_pending").alias("pending_promotions"), used.alias("watched_dirs")).withColumn("budget_percent", percent)


def expired(dirs: DataFrame, now: int, idle: int = IDLE_SECONDS) -> DataFrame:
    """Watched directories without an event for longer than ``idle`` seconds."""
    return dirs.where((F.col("tier") == "L0") & ~F.col("demotion_pending") & (F.col("last_event") > 0) & (F.lit(now) - F.col("last_event") > idle)).select("path")


def next_scans(dirs: DataFrame, n: int) -> DataFrame:
    """The ``n`` scanned directories that waited longest."""
    return dirs.where((F.col("tier") == "L1") & ~F.col("promotion_pending") & ~F.col("demotion_pending")).orderBy("last_scan", "path").limit(n).select("path")


def batch_size(items_per_second: int) -> int:
    return max(1, min(items_per_second // 500, 10))


SCANNED, PROMOTING, WATCHED, DEMOTING = "scanned", "promoting", "watched", "demoting"
#: What becomes of a directory: (its state, what happened) -> (its next state, times its cost that the budget in use changes).
MOVES = {
    (SCANNED, "wanted"): (PROMOTING, 1), (PROMOTING, "done"): (WATCHED, 0), (PROMOTING, "failed"): (SCANNED, -1),
    (WATCHED, "idle"): (DEMOTING, 0), (DEMOTING, "done"): (SCANNED, -1), (DEMOTING, "failed"): (WATCHED, 0),
}


@dataclass
class Directory:
    state: str = SCANNED
    watch_cost: int = 1
    last_event: int = 0
    last_scan: int = 0
    empty_scans: int = 0

    @property
    def tier(self) -> str:
        return "L0" if self.state in (WATCHED, DEMOTING) else "L1"


class WatchState:
    """The states of all directories; kept on the driver, as the budget is one for all."""

    def __init__(self, budget: int):
        self.budget, self.used, self.blocked = budget, 0, 0
        self.dirs: dict[str, Directory] = {}
        self.moved: Counter = Counter()

    @property
    def promotions(self) -> int:
        return self.moved[PROMOTING, "done"]

    @property
    def demotions(self) -> int:
        return self.moved[DEMOTING, "done"]

    def add(self, path: str, tier: str, cost: int, now: int) -> None:
        self.dirs[path] = Directory(WATCHED if tier == "L0" else SCANNED, cost, now)
        self.used += cost if tier == "L0" else 0

    def move(self, path: str, what: str) -> bool:
        """Whether the table has such a move for the directory, which is then made."""
        d = self.dirs.get(path)
        if d is None or (d.state, what) not in MOVES:
            return False
        self.moved[d.state, what] += 1
        d.state, times = MOVES[d.state, what]
        self.used = max(0, self.used + times * d.watch_cost)
        return True

    def touch(self, path: str, now: int) -> None:
        """An event renews the watched directories that it lies in; scanned ones wait for their scan."""
        for at in (path, *map(str, PurePosixPath(path).parents)):
            if (d := self.dirs.get(at)) is not None and d.tier == "L0":
                d.last_event, d.empty_scans = now, 0

    def register(self, path: str, cost: int, now: int) -> str:
        """Asks for a directory to be watched, at a cost."""
        d = self.dirs.setdefault(path, Directory())
        d.last_event = now
        if d.state == SCANNED:
            d.watch_cost = cost
        return self.reserve(path)

    def reserve(self, path: str) -> str:
        d = self.dirs.get(path)
        if d is None or d.state != SCANNED:
            return NOT_ELIGIBLE
        if self.used + d.watch_cost > self.budget:
            self.blocked += 1
            return BLOCKED
        self.move(path, "wanted")
        return SEND

    def settle_promotion(self, path: str, done: bool, now: int) -> None:
        if self.move(path, "done" if done else "failed") and done:
            self.dirs[path].last_event, self.dirs[path].empty_scans = now, 0

    def demote(self, path: str) -> bool:
        return self.move(path, "idle")

    def settle_demotion(self, path: str, done: bool) -> None:
        if self.move(path, "done" if done else "failed") and done:
            self.dirs[path].empty_scans = 0

    def scanned(self, path: str, changed: int, now: int) -> None:
        d = self.dirs[path]
        d.last_scan, d.empty_scans = now, 0 if changed else d.empty_scans + 1

    def tick(self, now: int, scan, watch, unwatch, idle: int = IDLE_SECONDS, items_per_second: int = 5_000) -> dict[str, int]:
        """One round: idle directories go back to being scanned, those that waited longest are scanned
        (``scan(path)`` says how much changed), and where something changed they are watched if the budget allows.

        ``watch(path)`` and ``unwatch(path)`` say whether they succeeded.
        """
        done = {"demoted": 0, "scanned": 0, "promoted": 0}
        for path in sorted(p for p, d in self.dirs.items() if d.last_event and now - d.last_event > idle):
            if self.demote(path):
                gone = unwatch(path)
                self.settle_demotion(path, gone)
                done["demoted"] += gone
        waiting = sorted((d.last_scan, p) for p, d in self.dirs.items() if d.state == SCANNED)
        for _, path in waiting[: batch_size(items_per_second)]:
            changed = scan(path)
            self.scanned(path, changed, now)
            done["scanned"] += 1
            if changed and self.reserve(path) == SEND:
                added = watch(path)
                self.settle_promotion(path, added, now)
                done["promoted"] += added
        return done
