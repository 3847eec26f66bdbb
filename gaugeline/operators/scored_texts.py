"""Asked words in a batch stream of texts, and the best texts for each question of a pack, tile by tile."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words that are counted together, documents of a tile, products (a word of a document times a question) that are added
#: together, and rows that wait to be cut to the best.
WORDS, TILE_DOCUMENTS, PRODUCTS, WAITING = 1 << 18, 512, 1 << 18, 1 << 16


def lists_of(shared):
    """A function over batches (id, ..., text) that gives (id, ..., length, terms, counts) of the texts that hold a term.

    ``shared`` are the terms; a term goes as its place among them. Texts are split as bytes, that is at the same white
    space as the words on Spark's side.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t.encode(): n for n, t in enumerate(shared.value)}
        get, n_terms = number.get, max(len(number), 1)

        def counted(batch, rows, lengths, sizes, found):
            keys, counts = np.unique(np.repeat(np.arange(len(rows)), sizes) * n_terms + np.array(found, "int64"), return_counts=True)
            ends = np.concatenate([[0], np.cumsum(np.bincount(keys // n_terms, minlength=len(rows)))])
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v, pa.int32())) for v in (keys % n_terms, counts)]
            kept = [c.take(pa.array(rows, pa.int64())) for c in batch.columns[:-1]]
            return pa.RecordBatch.from_arrays([*kept, pa.array(lengths, pa.int32()), *lists], [*batch.schema.names[:-1], "length", "terms", "counts"])

        for batch in batches:
            rows, lengths, sizes, found = [], [], [], []
            text = batch.column(batch.num_columns - 1)
            as_bytes = text.cast(pa.large_binary() if pa.types.is_large_string(text.type) else pa.binary())
            for row, value in enumerate(as_bytes):
                tokens = (value.as_py() or b"").split()
                own = [n for n in map(get, tokens) if n is not None]
                if own:
                    rows.append(row)
                    lengths.append(len(tokens))
                    sizes.append(len(own))
                    found += own
                if len(found) >= WORDS:
                    yield counted(batch, rows, lengths, sizes, found)
                    rows, lengths, sizes, found = [], [], [], []
            if rows:
                yield counted(batch, rows, lengths, sizes, found)

    return run


class Group:
    """The questions that read the same kinds of documents: for every term its weight and the questions that say it."""

    def __init__(self, terms: np.ndarray, units: np.ndarray, times: np.ndarray, idf: np.ndarray, mean: float | None, n_terms: int) -> None:
        order = np.argsort(terms, kind="stable")
        self.units, self.times = units[order], times[order].astype("float64")
        self.mean = mean if mean is not None and mean > 0 else 1.0
        self.said = np.bincount(terms, minlength=n_terms)
        self.start = np.cumsum(self.said) - self.said
        self.idf = np.zeros(n_terms)
        self.idf[terms] = idf


class Pack:
    """Questions with the weights of their terms as arrays.

    ``rows`` has (q, depth, grp, term, times, idf, mean_length); a unit is a question with its depth. ``readers`` names the groups
    that read a kind, ``k1`` and ``b`` are the constants of BM25.
    """

    def __init__(self, rows: pa.Table, readers: Mapping[str | None, Sequence[int]], k1: float, b: float) -> None:
        self.readers, self.k1, self.b = readers, k1, b
        names = list(zip(rows.column("q").to_pylist(), rows.column("depth").to_pylist(), strict=True))
        unit = {name: n for n, name in enumerate(dict.fromkeys(names))}
        self.query = pa.array([q for q, _ in unit], rows.schema.field("q").type)
        self.depth = pa.array([d for _, d in unit], pa.int32())
        said = rows.column("term").to_pylist()
        self.terms = sorted(set(said))
        place = {t: n for n, t in enumerate(self.terms)}
        units, terms = np.array([unit[n] for n in names], "int64"), np.array([place[t] for t in said], "int64")
        grp, times, idf = (rows.column(c).to_numpy() for c in ("grp", "times", "idf"))
        means = rows.column("mean_length").to_pylist()
        self.groups = {}
        for g in np.unique(grp):
            at = np.flatnonzero(grp == g)
            self.groups[int(g)] = Group(terms[at], units[at], times[at], idf[at], means[at[0]], len(self.terms))


class Tile:
    """Some documents and the terms in them.

    Rows of one id are one document; of these, rows of equal kind and length count their terms together.
    """

    def __init__(self, pack: Pack) -> None:
        self.pack = pack
        self.ids: list = []
        self.parts: dict[tuple, int] = {}
        self.keys, self.counts = [np.zeros(0, "int64")], [np.zeros(0, "int64")]
        self.size = 0

    def add(self, kind: str | None, length: int, terms: np.ndarray, counts: np.ndarray) -> None:
        part = self.parts.setdefault((len(self.ids) - 1, kind, length), len(self.parts))
        self.keys.append(part * len(self.pack.terms) + terms.astype("int64"))
        self.counts.append(counts)
        self.size += len(terms)
        if self.size >= WORDS:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        """One count per part and term, in their order: equal documents add up to equal sums."""
        keys, at = np.unique(np.concatenate(self.keys), return_inverse=True)
        counts = np.bincount(at, np.concatenate(self.counts), len(keys)).astype("int64")
        self.keys, self.counts, self.size = [keys], [counts], 0
        return keys, counts

    def scores(self) -> tuple[np.ndarray, np.ndarray]:
        """(documents x units): scores, and which of them share a term."""
        pack, n_units = self.pack, len(self.pack.query)
        keys, counts = self.merge()
        part, term = np.divmod(keys, len(pack.terms))
        document, length = (np.array([p[i] for p in self.parts], "int64") for i in (0, 2))
        cells = len(self.ids) * n_units
        total, met = np.zeros(cells), np.zeros(cells, bool)
        for number, group in pack.groups.items():
            read = np.array([number in pack.readers.get(kind, ()) for _, kind, _ in self.parts])
            own = np.flatnonzero(read[part] & (group.said[term] > 0))
            p, t, tf = part[own], term[own], counts[own]
            gain = group.idf[t] * (tf * (pack.k1 + 1) / (tf + pack.k1 * (1 - pack.b + pack.b * length[p] / group.mean)))
            ends = np.cumsum(group.said[t])
            first = 0
            while first < len(own):
                last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + PRODUCTS, "right")))
                each = group.said[t[first:last]]
                row = np.repeat(np.arange(first, last), each)
                said = group.start[t[row]] + np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
                cell = document[p[row]] * n_units + group.units[said]
                total += np.bincount(cell, gain[row] * group.times[said], cells)
                met[cell] = True
                first = last
        return np.round(total, 9).reshape(-1, n_units), met.reshape(-1, n_units)


class Best:
    """The k best (score, id) of each unit so far; equal scores keep the smaller id."""

    def __init__(self, units: int, k: int) -> None:
        self.k, self.most = k, WAITING + 2 * k * units
        self.least = np.full(units, -np.inf)
        self.rows: list[pa.Table] = []
        self.waiting = 0

    def add(self, tile: Tile, id_type: pa.DataType) -> None:
        score, met = tile.scores()
        document, unit = np.nonzero(met & (score >= self.least))
        ids = pa.array(tile.ids, id_type).take(pa.array(document))
        self.rows.append(pa.table({"unit": unit, "score": score[document, unit], "d": ids}))
        self.waiting += len(unit)
        if self.waiting > self.most:
            self.cut()

    def cut(self) -> pa.Table:
        rows = pa.concat_tables(self.rows)
        rows = rows.take(pc.sort_indices(rows, sort_keys=[("unit", "ascending"), ("score", "descending"), ("d", "ascending")], null_placement="at_start"))
        unit = rows.column("unit").to_numpy()
        place = np.arange(len(unit)) - np.searchsorted(unit, unit, "left")
        last = place == self.k - 1
        self.least[unit[last]] = rows.column("score").to_numpy()[last]
        rows = rows.filter(pa.array(place < self.k)).combine_chunks()
        self.rows, self.waiting = [rows], len(rows)
        return rows


def best_of(shared, k: int):
    """A function over batches (id, kind, length, terms, counts) that gives at most k rows (q, depth, d, score) per question and task.

    Rows of one id must follow each other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = shared.value
        best, tile, id_type = Best(len(pack.query), k), Tile(pack), None
        for batch in batches:
            id_type = batch.schema.field(0).type
            terms, counts = (batch.column(i).flatten().to_numpy() for i in (3, 4))
            ends = np.cumsum(batch.column(3).value_lengths().to_numpy())
            first = 0
            for name, kind, length, end in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2)), ends.tolist(), strict=True):
                if not tile.ids or name != tile.ids[-1]:
                    if len(tile.ids) >= TILE_DOCUMENTS:
                        best.add(tile, id_type)
                        tile = Tile(pack)
                    tile.ids.append(name)
                tile.add(kind, length, terms[first:end], counts[first:end])
                first = end
        if tile.ids:
            best.add(tile, id_type)
        if best.rows:
            rows = best.cut().to_batches(max_chunksize=1 << 16)
            for b in rows:
                yield pa.RecordBatch.from_arrays([pack.query.take(b.column(0)), pack.depth.take(b.column(0)), b.column(2), b.column(1)], ["q", "depth", "d", "score"])

    return run
