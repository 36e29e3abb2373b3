"""Several reports from shared scans.

A report asks for statistics (``functions.stats``) and waits for the answer.  ``together`` runs several reports side by side: when
all of them wait, what they ask for is merged - the aggregates over one table into one aggregate, the histogram passes of all
quantiles into one count, the distinct values, modes and duplicates of all columns into another - and answered by one job.
So the number of jobs is that of the longest chain of questions, not of the questions, and a report reads the same whether it runs
alone or with others.  Only answers whose size is bounded by columns, cells or checks come to the driver."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from typing import Any

from pyspark import InheritableThread
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

_HERE = threading.local()
_PLAIN = threading.Lock()
_plain_users: dict[str, Any] = {"n": 0, "before": None}

#: What merges the questions of one kind over one table: kind -> function of (table, payloads) that gives a frame with a
#: bounded number of rows and a function from its rows to one answer a payload.
MERGERS: dict[str, Callable[[DataFrame, list], tuple[DataFrame, Callable[[list[Row]], list]]]] = {}


@contextmanager
def plain_jobs(spark: SparkSession) -> Iterator[None]:
    """Without adaptive execution, which would make a job of every shuffle: for answers of a few rows."""
    key = "spark.sql.adaptive.enabled"
    with _PLAIN:
        if not _plain_users["n"]:
            _plain_users["before"] = spark.conf.get(key)
            spark.conf.set(key, "false")
        _plain_users["n"] += 1
    try:
        yield
    finally:
        with _PLAIN:
            _plain_users["n"] -= 1
            if not _plain_users["n"]:
                spark.conf.set(key, _plain_users["before"])


class _Question:
    def __init__(self, kind: str, df: DataFrame, payload: Any) -> None:
        self.kind, self.df, self.payload = kind, df, payload
        self.answer: Any = None
        self.failed: BaseException | None = None
        self.done = False


def _answer(questions: list[_Question]) -> None:
    """Answer all questions by one job."""
    groups: dict[tuple[str, int], list[_Question]] = {}
    for q in questions:
        groups.setdefault((q.kind, id(q.df)), []).append(q)
    merged = [(qs, *MERGERS[kind](qs[0].df, [q.payload for q in qs])) for (kind, _), qs in groups.items()]
    frames = [f for _, f, _ in merged]
    if len(frames) == 1:
        whole = frames[0]
    else:
        shapes = [f.schema for f in frames]
        whole = None
        for i, f in enumerate(frames):
            cells = [F.struct(*[F.col(f"`{n}`") for n in f.columns]) if i == j else F.lit(None).cast(s) for j, s in enumerate(shapes)]
            one = f.select(F.lit(i).alias("i"), *[x.alias(f"f{j}") for j, x in enumerate(cells)])
            whole = one if whole is None else whole.union(one)
    with plain_jobs(whole.sparkSession):
        rows = whole.collect()
    for i, (qs, _, read) in enumerate(merged):
        mine = rows if len(frames) == 1 else [r[f"f{i}"] for r in rows if r["i"] == i]
        for q, a in zip(qs, read(mine), strict=True):
            q.answer = a


class _Round:
    """The reports that run side by side, and what they wait for."""

    def __init__(self) -> None:
        self.change = threading.Condition()
        self.running = 0
        self.waiting: list[_Question] = []

    def ask(self, q: _Question) -> Any:
        with self.change:
            self.waiting.append(q)
            self.running -= 1
            self.change.notify_all()
            while not q.done:
                self.change.wait()
        if q.failed is not None:
            raise q.failed
        return q.answer

    def serve(self) -> None:
        """Answer until no report runs or waits; called by the thread that began."""
        while True:
            with self.change:
                while self.running:
                    self.change.wait()
                questions, self.waiting = self.waiting, []
            if not questions:
                return
            try:
                _answer(questions)
            except BaseException as e:  # every report that asked gets it
                for q in questions:
                    q.failed = e
            with self.change:
                for q in questions:
                    q.done = True
                self.running += len(questions)
                self.change.notify_all()


def ask(kind: str, df: DataFrame, payload: Any) -> Any:
    """The answer to one question, merged with those of the reports that run beside this one."""
    q = _Question(kind, df, payload)
    round_ = getattr(_HERE, "round", None)
    if round_ is not None:
        return round_.ask(q)
    _answer([q])
    return q.answer


def together(*reports: Callable[[], Any]) -> list:
    """What each report returns; their questions share jobs.  Inside another ``together`` the reports join its round."""
    if not reports:
        return []
    outer: _Round | None = getattr(_HERE, "round", None)
    round_ = outer or _Round()
    out: list = [None] * len(reports)
    failed: list[BaseException] = []
    left = [len(reports)]

    def work(i: int, report: Callable[[], Any]) -> None:
        _HERE.round = round_
        try:
            out[i] = report()
        except BaseException as e:
            failed.append(e)
        finally:
            with round_.change:
                left[0] -= 1
                if left[0] or outer is None:  # the last part of a report runs on as the report
                    round_.running -= 1
                    round_.change.notify_all()

    threads = [InheritableThread(target=work, args=(i, r), daemon=True) for i, r in enumerate(reports)]
    with round_.change:
        round_.running += len(threads) - (outer is not None)  # a report waits for its parts
    for t in threads:
        t.start()
    if outer is None:
        round_.serve()
    for t in threads:
        t.join()
    if failed:
        raise failed[0]
    return out


def _rows(df: DataFrame, payloads: list) -> tuple[DataFrame, Callable[[list[Row]], list]]:
    return df, lambda rows: [rows] * len(payloads)


MERGERS["rows"] = _rows


def bounded_rows(df: DataFrame) -> list[Row]:
    """The rows of a frame with a bounded number of them."""
    return ask("rows", df, None)


def shared(df: DataFrame, reports: Sequence[Callable[[DataFrame], Any]]) -> list:
    """``together`` over one table.  A small one is dealt to all cores and held in memory meanwhile."""
    from .stats import dealt

    with dealt(df) as held:
        return together(*[lambda r=r: r(held) for r in reports])
