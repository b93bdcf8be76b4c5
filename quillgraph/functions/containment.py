"""Exact 'name occurs in text' joins by one automaton per list of names."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

#: Names of one automaton and texts of one group, about; longer lists are dealt into parts by hash.
NAMES, TEXTS = 20_000, 20_000


def contains_join(texts: DataFrame, names: DataFrame, keys: list[str], ids: list[str], text: str, name: str,
                  most_names: int = NAMES, most_texts: int = TEXTS) -> DataFrame:
    """Pairs of a text and a name found in it, among rows that share ``keys`` (null keys share nothing).

    The names of a key become automata of bounded size and the texts of a key groups of
    bounded size; every text is read once for each automaton of its key, whatever the number of
    names, and every pair comes out once.  ``ids`` name the texts of a key.  Empty names are found
    nowhere.  Returns the columns of both sides.
    """
    parts = lambda n, most: F.ceil(F.col(n) / most).cast("int")
    sizes = names.filter(F.length(name) > 0).groupBy(*keys).agg(F.count("*").alias("_names")).join(
        texts.groupBy(*keys).agg(F.count("*").alias("_texts")), keys).select(
        *keys, parts("_names", most_names).alias("_lists"), parts("_texts", most_texts).alias("_groups"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n, *by: F.pmod(F.xxhash64(*by), F.col(n)).cast("int")
    kept = [c for c in names.columns if c not in keys]
    dealt_texts = texts.join(sizes, keys).withColumns({"_group": own("_groups", *ids), "_list": every("_lists")}).select(
        F.to_json(F.struct(*keys, "_list", "_group")).alias("_at"), *keys, F.struct(*texts.columns).alias("t"), F.col(text).alias("word"))
    dealt_names = names.filter(F.length(name) > 0).join(sizes, keys).withColumns({"_list": own("_lists", name), "_group": every("_groups")}).select(
        F.to_json(F.struct(*keys, "_list", "_group")).alias("_at"), *keys, F.struct(*kept).alias("n"), F.col(name).alias("word"))
    rows = dealt_names.drop(*keys).unionByName(dealt_texts.drop(*keys), allowMissingColumns=True)
    schema = T.StructType([f for f in rows.schema if f.name in ("t", "n")])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, machine, held, indices = None, None, [], {}
        for batch in batches:
            is_name = batch.column("n").is_valid().to_pylist()
            texts_out, names_out = [], []
            for i, (group, word) in enumerate(zip(batch.column("_at").to_pylist(), batch.column("word").to_pylist())):
                if group != at:
                    at, machine, held, indices = group, None, [], {}
                if is_name[i]:
                    indices.setdefault(word, []).append(len(held))
                    held.append((batch, i))
                elif word and indices:
                    if machine is None:
                        machine = ahocorasick.Automaton()
                        for found in indices:
                            machine.add_word(found, found)
                        machine.make_automaton()
                    for found in dict.fromkeys(f for _, f in machine.iter(word)):
                        for which in indices[found]:
                            texts_out.append(i)
                            names_out.append(held[which])
            if texts_out:
                sources = {id(b): b for b, _ in names_out}
                place = {k: n for n, k in enumerate(sources)}
                starts = [0]
                for b in sources.values():
                    starts.append(starts[-1] + b.num_rows)
                pool = pa.concat_arrays([b.column("n") for b in sources.values()])
                yield pa.RecordBatch.from_arrays([
                    pool.take(pa.array([starts[place[id(b)]] + i for b, i in names_out])), batch.column("t").take(pa.array(texts_out))], names=["n", "t"])

    # Names of a group come before its texts.
    ordered = rows.repartition("_at").sortWithinPartitions("_at", F.col("n").isNull())
    columns = [f"t.{c}" for c in texts.columns] + [f"n.{c}" for c in kept if c not in texts.columns]
    return ordered.mapInArrow(search, T.StructType([schema["n"], schema["t"]])).select(*columns)
