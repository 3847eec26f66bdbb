"""Byte-level BPE encoding and decoding (operator 8).

The merges are compiled, as texts need it, into a deterministic transducer. A piece's prefix
has one canonical encoding, found from those of shorter prefixes: its last token is the
one vocabulary token that ends there and may follow the last token of the prefix before it
(two tokens may be neighbours if merging their joined bytes gives the two again).

Undetermined, the transducer is in one configuration per place where a token may have begun: the node
of the trie of tokens that the bytes since then lead to, and the tokens before that place. A
byte moves every configuration along the trie; the one that reaches the canonical last token opens
another at the root. A state of the determinised transducer is the list of configurations: tokens
that all of them share are emitted at once and taken off, so a state holds little more than the longest
token and lookahead is bounded however long the piece is. Every state and every move is made
when a text first needs it and kept; the table is emptied when it is full.

Null and empty texts give no tokens; repeated rows give a row each; an empty table no rows; only the columns that are
read are taken, so others may have any name. Nothing is cut off: memory follows the longest text.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import itertools
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.llm.common import only

#: States kept before the table is emptied; with their moves about half a KB each.
MAX_STATES = 400_000
#: Pairs of tokens whose neighbourhood is remembered.
MAX_PAIRS = 400_000
#: Pieces whose ids are kept as one move from the start state.
MAX_PIECES = 300_000
#: Tokens handed to the decoder at a time.
DECODE_CHUNK = 4096

#: A place where a token may have begun: trie node since then, and the tokens before it from the last emitted one (-1: none) on.
Configuration = tuple[int, tuple[int, ...]]

IDS_SCHEMA = "doc_id long, ids array<int>"
DIGEST_SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file: a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def merge_all(piece: bytes, ranks: dict[bytes, int], below: int = 1 << 60) -> list[bytes]:
    """Plain merging by ranks under ``below``, lowest first and leftmost among equals."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best, at = min((ranks.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1))
        if best >= below:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Transducer:
    """Encoder of single pieces, determinised as it runs; states are numbers, 0 a piece's start."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = MAX_STATES) -> None:
        self.ranks, self.max_states = ranks, max_states
        self.size = max(ranks.values(), default=0) + 1
        self.names: list[bytes] = [b""] * self.size
        # The two parts a token is merged from last, for the tokens that merging makes; any
        # other token stands only for a piece that equals it.
        self.halves: list[tuple[int, int] | None] = [None] * self.size
        # The trie: the node that a node and a byte lead to, each node's token (-1: none), and which nodes go on.
        self.steps: dict[int, int] = {}
        self.tokens, self.goes_on = [-1], [True]
        for token, rank in sorted(ranks.items(), key=lambda item: item[1]):
            self.names[rank] = token
            if len(token) > 1:
                parts = merge_all(token, ranks, rank)
                if len(parts) != 2:
                    continue
                self.halves[rank] = (ranks[parts[0]], ranks[parts[1]])
            self.plant(token, rank)
        self.pairs: dict[int, bool] = {}
        # By state and byte: the next state, and the tokens that became certain.
        self.moves: dict[int, tuple[int, tuple[int, ...]]] = {}
        self.reset()

    def plant(self, token: bytes, rank: int) -> None:
        node = 0
        for byte in token:
            self.goes_on[node] = True
            step = node << 8 | byte
            if step not in self.steps:
                self.steps[step] = len(self.tokens)
                self.tokens.append(-1)
                self.goes_on.append(False)
            node = self.steps[step]
        self.tokens[node] = rank

    def reset(self) -> None:
        start = ((0, (-1,)),)
        self.numbers: dict[tuple[Configuration, ...], int] = {start: 0}
        self.states: list[tuple[Configuration, ...]] = [start]
        self.moves.clear()

    def neighbours(self, left: int, right: int) -> bool:
        """Whether merging the joined bytes of two tokens gives these two.

        The merges inside each token are undone at the border, latest first. Two parts that
        met at the border while both were whole must not have been joined by a lower rank
        than the merge that ended the meeting.
        """
        names, halves = self.names, self.halves
        left_limit = right_limit = 1 << 60
        while True:
            joined = self.ranks.get(names[left] + names[right])
            # At equal rank the leftmost merge goes first: the left token's own merge before the
            # joint one, the joint one before the right token's own.
            if joined is not None and joined < left_limit and joined <= right_limit:
                return False
            left_rank = left if halves[left] else -1
            right_rank = right if halves[right] else -1
            if left_rank < 0 and right_rank < 0:
                return True
            if left_rank > right_rank:
                left_limit, left = left_rank, halves[left][1]
                right_limit = min(right_limit, left_limit - 1)
            else:
                right_limit, right = right_rank, halves[right][0]
                left_limit = min(left_limit, right_limit + 1)

    def may_follow(self, left: int, right: int) -> bool:
        """Whether two tokens may be neighbours, kept for the next time."""
        if len(self.pairs) >= MAX_PAIRS:
            self.pairs.clear()
        fits = self.pairs[left * self.size + right] = self.neighbours(left, right)
        return fits

    def extend(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """Make the move of ``state`` on ``byte``: the next state and the tokens that became certain."""
        step, tokens, goes_on, pairs, size = self.steps.get, self.tokens, self.goes_on, self.pairs, self.size
        configurations: list[Configuration] = []
        encoding = None
        for configuration in self.states[state]:
            child = step(configuration[0] << 8 | byte)
            if child is None:
                continue
            before = configuration[1]
            if encoding is None:
                token = tokens[child]
                if token >= 0:
                    last = before[-1]
                    fits = last < 0 or pairs.get(last * size + token)
                    if fits is None:
                        fits = self.may_follow(last, token)
                    if fits:
                        encoding = (*before, token)
            if goes_on[child]:
                configurations.append((child, before))
        if encoding is None:
            raise ValueError("a byte has no token of its own")
        # The first tokens that all configurations share are certain.
        if not configurations:
            emitted = encoding[1:]
            configurations = [(0, encoding[-1:])]
        else:
            certain = len(configurations[0][1])
            if certain > 1:
                for _, before in configurations:
                    certain = min(certain, len(before))
                    while before[:certain] != encoding[:certain]:
                        certain -= 1
            emitted = encoding[1:certain]
            if emitted:
                encoding = encoding[certain - 1 :]
                configurations = [(node, before[certain - 1 :]) for node, before in configurations]
            configurations.append((0, encoding))
        key = tuple(configurations)
        found = self.numbers.get(key)
        if found is None:
            full = len(self.states) >= self.max_states
            if full:
                self.reset()
            found = self.numbers[key] = len(self.states)
            self.states.append(key)
            if full:
                # The state that is left went with the table.
                return found, emitted
        move = self.moves[state << 8 | byte] = (found, emitted)
        return move

    def open_bytes(self, state: int) -> int:
        """How many bytes a state has read since the last emitted token."""
        return sum(len(self.names[token]) for token in self.states[state][-1][1][1:])

    def run(self, piece: bytes) -> list[int]:
        state, out, known = 0, [], self.moves
        for byte in piece:
            move = known.get(state << 8 | byte)
            if move is None:
                move = self.extend(state, byte)
            state, emitted = move
            if emitted:
                out += emitted
        # The last configuration is the one of all bytes read.
        out += self.states[state][-1][1][1:]
        return out

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        whole = self.ranks.get(piece)
        return (whole,) if whole is not None else tuple(self.run(piece))


class Pieces(dict):
    """Ids of the pieces met lately: a piece that comes again is one step from the start state."""

    def __init__(self, transducer: Transducer) -> None:
        super().__init__()
        self.transducer = transducer

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.transducer.encode_piece(piece.encode("utf-8", "surrogatepass"))
        if len(piece) <= 32:
            if len(self) >= MAX_PIECES:
                self.clear()
            self[piece] = ids
        return ids


class Utf8Stream:
    """Text of byte chunks as they come; a character split between chunks waits for its rest.

    Bytes that are no UTF-8 become U+FFFD, as in a decoding of the whole.
    """

    def __init__(self) -> None:
        self.waiting = b""

    @staticmethod
    def open_tail(data: bytes) -> int:
        """How many of the last bytes begin a character that is not complete."""
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte & 0xC0 == 0x80:
                continue
            need = 4 if 0xF0 <= byte <= 0xF4 else 3 if 0xE0 <= byte <= 0xEF else 2 if 0xC2 <= byte <= 0xDF else 1
            if need <= back:
                return 0
            if back > 1:
                # The byte after the first has a narrower range for some first bytes.
                low, high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(byte, (0x80, 0xBF))
                if not low <= data[1 - back] <= high:
                    return 0
            return back
        return 0

    def feed(self, data: bytes) -> str:
        data = self.waiting + data
        cut = len(data) - self.open_tail(data)
        self.waiting = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.waiting = self.waiting, b""
        return rest.decode("utf-8", "replace")


class Codec:
    """Text to ids and back for a vocabulary and a pattern that splits texts."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.transducer = Transducer(ranks)
        self.names = {rank: token for token, rank in ranks.items()}
        self.split = regex.compile(pattern)
        self.pieces = Pieces(self.transducer)

    def encode(self, text: str) -> array:
        return array("I", itertools.chain.from_iterable(map(self.pieces.__getitem__, self.split.findall(text))))

    def decode(self, ids: Sequence[int]) -> Iterator[bytes]:
        for k in range(0, len(ids), DECODE_CHUNK):
            yield b"".join(map(self.names.__getitem__, ids[k : k + DECODE_CHUNK]))

    def decode_text(self, ids: Sequence[int]) -> Iterator[str]:
        stream = Utf8Stream()
        for data in self.decode(ids):
            yield stream.feed(data)
        yield stream.close()


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The codec of a vocabulary file, made once in each worker."""
    key = (path, pattern)
    if key not in _CODECS:
        _CODECS[key] = Codec(read_ranks(path), pattern)
        # The tables are large and hold no cycles: going through them again and again frees nothing.
        gc.freeze()
        gc.set_threshold(200_000, 20, 100)
    return _CODECS[key]


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and the ids of the whole text, one row per row of ``docs``."""

    def encode(batches):
        own = codec(path, pattern)
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                ids = [own.encode(t.as_py() or "") for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.tolist() for x in ids], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return only(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(encode, IDS_SCHEMA)


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and the text of its ids, decoded as a stream."""

    def decode(batches):
        own = codec(path, pattern)
        for batch in batches:
            texts = ["".join(own.decode_text(ids.as_py() or ())) for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return only(encoded, "doc_id", "ids").mapInArrow(decode, "doc_id long, text string")


def round_trip_digests(docs: DataFrame, path: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """Encode every whole text, decode the ids again, and return counts and digests of both, with the ids if wanted."""

    def digest(batches):
        own = codec(path, pattern)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part, rows, kept = batch.slice(k, 256), [], []
                for text in part.column(1):
                    ids = own.encode(text.as_py() or "")
                    decoded, stream = hashlib.sha256(), Utf8Stream()
                    for data in own.decode(ids):
                        decoded.update(stream.feed(data).encode("utf-8"))
                    decoded.update(stream.close().encode("utf-8"))
                    rows.append((len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), decoded.hexdigest()))
                    if keep_ids:
                        kept.append(np.frombuffer(ids, dtype=np.int32))
                columns = [part.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.string()), strict=True))]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    columns.append(pa.array(kept, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = DIGEST_SCHEMA + (", ids array<int>" if keep_ids else "")
    return only(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(digest, schema)
