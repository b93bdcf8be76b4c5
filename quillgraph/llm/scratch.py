"""Cuts and shared tables of one operator call, removed together once their last reader is written."""

from __future__ import annotations

from pyspark import Broadcast
from pyspark.sql import Column, DataFrame

from quillgraph.llm.sketches import Membership
from quillgraph.session import discard, materialise


class Scratch:
    def __init__(self) -> None:
        self._cuts: list[DataFrame] = []
        self._shared: list[Broadcast] = []

    def cut(self, df: DataFrame) -> DataFrame:
        made = materialise(df)
        self._cuts.append(made)
        return made

    def keep(self, cut: DataFrame) -> None:
        self._cuts.append(cut)

    def share(self, df: DataFrame, value: object) -> Broadcast:
        shared = df.sparkSession.sparkContext.broadcast(value)
        self._shared.append(shared)
        return shared

    def members(self, keys: DataFrame, key: Column, hashed: bool = False) -> Membership:
        found = Membership(keys, key, hashed=hashed)
        self._shared.append(found.shared)
        return found

    def clear(self) -> None:
        """Nothing that was made here may be read any more."""
        for cut in self._cuts:
            discard(cut)
        for shared in self._shared:
            shared.destroy()
        self._cuts, self._shared = [], []
