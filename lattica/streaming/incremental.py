"""Keep a closure up to date while axioms arrive as a stream of encoded rows.

The rules are monotone: what was derived stays. So a micro-batch costs what its
axioms and facts give together with what is known, and the rounds that follow
from that; relations grow by parts, and nothing that was written is written again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lattica.operators.setops import delta
from lattica.plans.closure import Closure, Parts, classify
from lattica.schemas import columns
from lattica.storage import shared_path, written

#: Columns of a streamed axiom: relation is s or t1 .. t6; c is null where a relation has two columns.
STREAMED = "relation string, a long, b long, c long"


class Incremental:
    def __init__(self, tables: dict[str, DataFrame]) -> None:
        self.parts = {k: Parts(df, k) for k, df in tables.items()}
        self.closure: Closure = classify(self.tables)

    @property
    def tables(self) -> dict[str, DataFrame]:
        return {k: p.all for k, p in self.parts.items()}

    def add(self, batch: DataFrame) -> Closure:
        rows = written(batch.select("relation", "a", "b", "c"), shared_path(batch.sparkSession, "batch"))
        here = {r["relation"] for r in rows.select("relation").distinct().limit(len(self.parts) + 1).collect()}  # names of relations
        if unknown := here - set(self.parts):
            raise ValueError(f"unknown relation: {min(unknown, key=repr)}")
        added = {}
        for k in sorted(here):
            names = columns(k)
            new = rows.where(f"relation = '{k}'").select(*("a", "b", "c")[: len(names)]).toDF(*names)
            self.parts[k].compact()
            added[k] = self.parts[k].add(delta(new, self.parts[k].all))
        self.closure = classify(self.tables, known=self.closure, added=added)
        return self.closure

    def start(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        """Follow a stream of STREAMED rows; a batch that is repeated adds nothing."""
        return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: self.add(df) and None).start()
