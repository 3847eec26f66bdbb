"""Names in texts by an automaton: every text is read once, wherever a name stands in it."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.session import ship

#: Names of one automaton: a bound on what the driver sends and a task holds. More names go out in several passes.
NAMES_PER_PASS = 200_000

_AUTOMATA: dict[str, ahocorasick.Automaton] = {}


def automaton_of(key: str, names: list[str]) -> ahocorasick.Automaton:
    """The automaton of a pack of names, built once per worker process."""
    if key not in _AUTOMATA:
        _AUTOMATA.clear()
        made = ahocorasick.Automaton()
        for number, name in enumerate(names):
            made.add_word(name, number)
        made.make_automaton()
        _AUTOMATA[key] = made
    return _AUTOMATA[key]


def names_in_texts(texts: DataFrame, id_column: str, text: str, names: DataFrame, name: str) -> DataFrame:
    """(id, name) of every name that is a part of the text, each once per text.

    Text and names compare as they are; null and empty ones hold and are nothing. The distinct names are packed by their
    hash into automata of NAMES_PER_PASS names at most; a pass reads each text once, whatever the number of
    names, so time follows the length of the texts and the number of names found. Rows with one id give a row each.
    """
    spark = texts.sparkSession
    ship(spark)
    distinct = names.select(F.col(name).alias("__name")).filter(F.coalesce(F.col("__name"), F.lit("")) != "").distinct()
    count = distinct.count()
    # Twice as many packs as needed, so that none outgrows its bound by the chance of the hash.
    packs = 1 if count <= NAMES_PER_PASS else 2 * -(-count // NAMES_PER_PASS)
    rows = texts.select(id_column, text).filter(F.coalesce(F.col(text), F.lit("")) != "")
    id_type = texts.schema[id_column].dataType.simpleString()
    found = None
    for number in range(packs):
        own = distinct.filter(F.pmod(F.xxhash64("__name"), F.lit(packs)) == number) if packs > 1 else distinct
        shared = spark.sparkContext.broadcast(sorted(r[0] for r in own.collect()))
        part = rows.mapInArrow(_reader(shared, name), f"`{id_column}` {id_type}, `{name}` string")
        found = part if found is None else found.unionByName(part)
    return found


def _reader(shared, name: str):
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = shared.value
        automaton = automaton_of(key, names) if names else None
        for batch in batches if automaton else ():
            places, hits = [], []
            for place, text in enumerate(batch.column(1).to_pylist()):
                met = {number for _, number in automaton.iter(text)}
                places.extend([place] * len(met))
                hits.extend(sorted(met))
            if hits:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(places, pa.int64())), pa.array([names[n] for n in hits], pa.string())], [batch.schema.names[0], name]
                )

    return run
