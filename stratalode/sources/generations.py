"""Immutable generations of tables under one folder, published by compare-and-swap.

Every attempt writes its tables to a folder of its own.  A pointer file
``_CURRENT-<n>`` names the folder of generation n; the highest pointer is in
force.  Publishing names the generation it expects to replace: if another writer
was first, its pointer stays and nothing it published changes.  Attempts are
recorded beside it; a terminal state is never overwritten.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from .pointers import Folder, fresh

TERMINAL = ("ready", "failed", "interrupted", "publication_uncertain")


class Store:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.files = Folder(spark, self.folder)

    def current(self) -> int:
        return max([0, *(int(n[len("_CURRENT-") :]) for n in self.files.names("_CURRENT-"))])

    def write(self, tables: dict[str, DataFrame]) -> str:
        """Writes tables to a folder of their own and returns its name; nobody sees them before ``publish``."""
        name = fresh("tables")
        for table, df in tables.items():
            df.write.parquet(f"{self.folder}/{name}/{table}")
        return name

    def publish(self, written: str, expected: int) -> bool:
        """Makes what ``write`` returned the generation after ``expected``; False if another writer was first."""
        return self.current() == expected and self.files.claim(f"_CURRENT-{expected + 1}", written)

    def _at(self, generation: int | None) -> str | None:
        g = self.current() if generation is None else generation
        return self.files.read(f"_CURRENT-{g}") if g and self.files.exists(f"_CURRENT-{g}") else None

    def read(self, table: str, generation: int | None = None) -> DataFrame:
        """A table of a pinned generation; the current one by default."""
        at = self._at(generation)
        if at is None:
            raise LookupError("nothing was published yet" if generation is None else f"no generation {generation}")
        return self.spark.read.parquet(f"{self.folder}/{at}/{table}")

    def tables(self, generation: int | None = None) -> list[str]:
        at = self._at(generation)
        return Folder(self.spark, f"{self.folder}/{at}").names() if at else []

    def generation_of(self, written: str) -> int | None:
        """The generation under which a written folder was published, if it was."""
        for n in self.files.names("_CURRENT-"):
            if self.files.read(n) == written:
                return int(n[len("_CURRENT-") :])
        return None

    def attempt(self, ident: str, state: str, **fields) -> dict:
        """Records the state of an attempt; raises once it has ended."""
        known = self.attempt_state(ident)
        if known and known["state"] in TERMINAL:
            raise ValueError(f"attempt {ident} ended as {known['state']}")
        record = {**(known or {}), **fields, "attempt": ident, "state": state}
        attempts = Folder(self.spark, f"{self.folder}/attempts")
        attempts.replace(f"{ident}.json", json.dumps(record, sort_keys=True))
        return record

    def attempt_state(self, ident: str) -> dict | None:
        attempts = Folder(self.spark, f"{self.folder}/attempts")
        return json.loads(attempts.read(f"{ident}.json")) if attempts.exists(f"{ident}.json") else None


def lifecycle(store: Store, ident: str, build) -> int:
    """Runs ``build() -> tables`` as one attempt and publishes what it returns; the prior generation stays in force if anything fails.

    Where publishing itself fails and a look at the pointers can't tell whether it
    took effect, the attempt ends as ``publication_uncertain``.
    """
    store.attempt(ident, "updating")
    expected = store.current()
    try:
        written = store.write(build())
    except KeyboardInterrupt:
        store.attempt(ident, "interrupted")
        raise
    except Exception as e:
        store.attempt(ident, "failed", error=type(e).__name__)
        raise
    try:
        ok = store.publish(written, expected)
    except Exception as e:
        try:
            ok = store.generation_of(written) is not None
        except Exception:
            store.attempt(ident, "publication_uncertain", error=type(e).__name__, written=written)
            raise e from None
        if not ok:
            store.attempt(ident, "failed", error=type(e).__name__)
            raise
    store.attempt(ident, "ready" if ok else "failed", generation=expected + 1, written=written)
    if not ok:
        raise RuntimeError("another writer published first")
    return expected + 1
