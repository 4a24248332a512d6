"""Claims as leases and books kept by retraction: state that streams change, with timers.

Both need the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quillspark.operators.merge import STEPS
from quillspark.operators.pipeline import DONE, FAILED, rolled_up

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MINUTES, PAGES_A_BOOK = 15, 10

OUTCOMES = "book_id string, page_id long, claimant string, outcome string, at timestamp"
LEASES = "book_id string, page_id long, claimant string, at timestamp"


def _millis(at) -> int:
    return int(pd.Timestamp(at).timestamp() * 1000)


def _time(millis: int) -> pd.Timestamp:
    return pd.Timestamp(millis, unit="ms")


class Leases(StatefulProcessor):
    """One book's leases: by page who holds it and since when."""

    def __init__(self, minutes: int, pages_a_book: int):
        self.span, self.most = minutes * 60_000, pages_a_book

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "page_id long", "claimant string, at long")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        for r in initialState.itertuples(index=False):
            self._grant(int(r.page_id), r.claimant, _millis(r.at))

    def _grant(self, page: int, claimant: str, at: int) -> None:
        self.held.updateValue((page,), (claimant, at))
        self.handle.registerTimer(at + self.span)

    def _leases(self) -> dict[int, tuple[str, int]]:
        return {k[0]: (v[0], v[1]) for k, v in self.held.iterator()} if self.held.exists() else {}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out, held = [], self._leases()
        asked = pd.concat(list(rows)).sort_values(["at", "page_id", "claimant", "released"])
        for r in asked.itertuples(index=False):
            page, at = int(r.page_id), _millis(r.at)
            for other, (who, since) in sorted(held.items()):
                if since + self.span <= at:
                    out.append((other, who, "expired", since + self.span))
                    del held[other]
                    self.held.removeKey((other,))
            own = held.get(page)
            if r.released:
                if own and own[0] == r.claimant:
                    out.append((page, r.claimant, "released", at))
                    del held[page]
                    self.held.removeKey((page,))
            elif own or len(held) >= self.most:
                out.append((page, r.claimant, "refused", at))
            else:
                self._grant(page, r.claimant, at)
                held[page] = (r.claimant, at)
                out.append((page, r.claimant, "granted", at))
        yield self._frame(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out, now = [], expiredTimerInfo.getExpiryTimeInMs()
        for page, (who, since) in sorted(self._leases().items()):
            if since + self.span <= now:  # a page granted anew since has a timer of its own
                out.append((page, who, "expired", since + self.span))
                self.held.removeKey((page,))
        yield self._frame(key, out)

    def _frame(self, key, out: list[tuple]) -> pd.DataFrame:
        rows = [(key[0], page, who, what, _time(at)) for page, who, what, at in out]
        frame = pd.DataFrame(rows, columns=["book_id", "page_id", "claimant", "outcome", "at"])
        return frame.astype({"page_id": "int64", "at": "datetime64[ns]"})


def leases(requests: DataFrame, held: DataFrame | None = None, minutes: int = MINUTES, pages_a_book: int = PAGES_A_BOOK, late: str = "0 seconds") -> DataFrame:
    """What becomes of ``requests`` (book_id, page_id, claimant, at, released): a row of ``OUTCOMES`` for each that matters.

    A page is granted to one claimant at a time, and a book has at most ``pages_a_book`` granted pages. A claimant releases
    a page with ``released``; a release of another's page does nothing. A lease ends by itself after so many minutes: when
    the watermark passes its end, or when a later request of its book arrives. Of requests in one batch the earlier one
    counts first, of equally early ones that of the smaller page, then claimant. ``held`` are leases from before
    (``LEASES``). A book's state is its leases alone; requests without a page or claimant are left out.
    """
    asked = requests.where("book_id IS NOT NULL AND page_id IS NOT NULL AND claimant IS NOT NULL AND at IS NOT NULL").select("book_id", F.col("page_id").cast("long").alias("page_id"), "claimant", "at", F.coalesce("released", F.lit(False)).alias("released"))
    before = held.groupBy("book_id") if held is not None else None
    return asked.withWatermark("at", late).groupBy("book_id").transformWithStateInPandas(Leases(minutes, pages_a_book), OUTCOMES, "append", "eventtime", before)


def held_now(outcomes: DataFrame) -> DataFrame:
    """``LEASES`` from the outcomes so far: pages whose last outcome, refusals aside, is a grant."""
    told = outcomes.where("outcome <> 'refused'")
    # At one time an end comes before a grant.
    order = F.struct("at", (F.col("outcome") == "granted").alias("granted"))
    last = told.groupBy("book_id", "page_id").agg(F.max_by(F.struct("claimant", "outcome", "at"), order).alias("l"))
    return last.where("l.outcome = 'granted'").select("book_id", "page_id", "l.claimant", "l.at")


#: Counts of a book: total, and for each step its done, failed and active pages.
_COUNTS = ["total", *(f"{s}{k}" for s in STEPS for k in ("", "_failed", "_active"))]
BOOK_COUNTS = "book_id string, " + ", ".join(f"{c} long" for c in _COUNTS)


def _counts_of(milestones: tuple) -> list[int]:
    out = [1]
    for s, m in zip(STEPS, milestones, strict=True):
        out += [int(m == DONE[s]), int(m in FAILED), int(m == "in_progress")]
    return out


class BookCounts(StatefulProcessor):
    """One book's counts and, by page, the milestones that are counted in them."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        of = ", ".join(f"{s} string" for s in STEPS)
        self.pages = handle.getMapState("pages", "page_id long", f"{of}, version long")
        self.counts = handle.getValueState("counts", ", ".join(f"{c} long" for c in _COUNTS))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        counts = list(self.counts.get()) if self.counts.exists() else [0] * len(_COUNTS)
        changes = pd.concat(list(rows)).sort_values(["page_id", "version"])
        for r in changes.drop_duplicates("page_id", keep="last").itertuples(index=False):
            page = (int(r.page_id),)
            old = self.pages.getValue(page) if self.pages.exists() and self.pages.containsKey(page) else None
            if old is not None and old[-1] >= r.version:
                continue
            new = tuple(None if pd.isna(m) else m for m in (getattr(r, f"{s}_milestone") for s in STEPS))
            if old is not None and not old[-2] == "":
                counts = [a - b for a, b in zip(counts, _counts_of(tuple(old[:-1])), strict=True)]
            if r.deleted:
                self.pages.updateValue(page, ("",) * len(STEPS) + (int(r.version),))
            else:
                counts = [a + b for a, b in zip(counts, _counts_of(new), strict=True)]
                self.pages.updateValue(page, tuple(m or "unknown" for m in new) + (int(r.version),))
        self.counts.update(tuple(counts))
        yield pd.DataFrame([(key[0], *counts)], columns=["book_id", *_COUNTS])


def book_counts(changes: DataFrame) -> DataFrame:
    """``BOOK_COUNTS`` of each book that a batch changes, from ``changes`` (book_id, page_id, version, deleted, and the milestones).

    A change retracts what its page counted for before and adds what it counts for now, so a book is never counted anew. Of
    a page's changes the greatest version stands, in whatever order they come; a deleted page stays so until a later one.
    """
    rows = changes.select("book_id", F.col("page_id").cast("long").alias("page_id"), F.col("version").cast("long").alias("version"), F.coalesce("deleted", F.lit(False)).alias("deleted"), *[f"{s}_milestone" for s in STEPS])
    rows = rows.where("book_id IS NOT NULL AND page_id IS NOT NULL AND version IS NOT NULL")
    return rows.groupBy("book_id").transformWithStateInPandas(BookCounts(), BOOK_COUNTS, "update", "none")


def book_states(counts: DataFrame) -> DataFrame:
    """Milestones of books by their counts, as the batch roll-up has them."""
    return counts.select("book_id", *[rolled_up(F.col(s), F.col(f"{s}_failed"), F.col(f"{s}_active"), F.col("total")).alias(f"{s}_milestone") for s in STEPS])
