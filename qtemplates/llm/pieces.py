"""SentencePiece segmentations by forward filtering, backward sampling.

A text, with one space put in front, is cut into units that no piece crosses
(spaces with the characters up to the next space; newlines stand alone).  On
the lattice of all pieces over a unit the forward pass sums the weights of all
segmentations up to each character; the backward pass draws the last piece in
proportion to its weight times the sum before it, and so on to the start.  A
segmentation thus has probability proportional to the product of its pieces'
weights.  Weights come from the vocabulary: a merge's rank, as ``1 / (rank +
2) ** sharpness``.  A character without a piece of its own is written as its
UTF-8 byte pieces, so every text can be encoded, and decoding gives it back
byte for byte: in a piece U+2581 stands for a space, a literal U+2581 in a
text is written in bytes.

The draws of a row depend on its key, the place of the unit and the step only,
never on partitions or batches: reruns agree.  Within a task the forward pass
runs once per distinct unit (a bounded memory of units) and the backward pass
runs over all units of a batch at once in numpy.

Cases: a null text counts as empty; an empty text has no pieces; null keys
share one seed; repeated rows get equal pieces; texts of any length and
characters round-trip; an empty table gives an empty result; added columns
take names that are still free.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from qtemplates.llm.common import free_name, text_or_empty

MODEL = "piece_bpe_32k.model"
SHARPNESS = 1.0
SEED = 7
#: Units and lattice edges remembered in a worker at most.
_UNITS, _EDGES = 300_000, 6_000_000
#: Edges that there is room for without copying.
_ROOM = _EDGES + (_EDGES >> 2)
#: Characters of text handled at once (a longer text alone).
_CHUNK = 1 << 19
#: Units longer than this are not remembered beyond their batch.
_LONG = 64
#: Units are filtered forward together by the next of these widths, in
#: blocks of so many characters; longer ones one by one.
_WIDTHS, _CELLS = (4, 6, 8, 10, 12, 14, 16, 20, 24, 32, 48), 1 << 16
#: Bits of a table of piece hashes, and which bits of a hash choose the place.
_SLOTS, _SHIFTS = 18, (46, 28, 10)
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def default_model() -> str:
    import public_tokenizers
    return public_tokenizers.path(MODEL)


def mix(x):
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def _codes(texts: list[str], width: int) -> np.ndarray:
    """Code points, one row per text, filled up with 0."""
    joined = "".join(t.ljust(width, "\0") for t in texts)
    return np.frombuffer(joined.encode("utf-32-le"), "<u4").reshape(len(texts), width)


def _prefixes(codes: np.ndarray) -> np.ndarray:
    """Polynomial hashes of all beginnings of each row."""
    out = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
    value = mix(codes.astype(np.uint64) + _M1)
    for j in range(codes.shape[1]):
        out[:, j + 1] = out[:, j] * _M2 + value[:, j]
    return out


def _windows(codes: np.ndarray, k: int, prefixes: np.ndarray | None = None) -> np.ndarray:
    """Hashes of the windows of k characters of each row, by their start."""
    h = _prefixes(codes) if prefixes is None else prefixes
    return h[:, k:] - h[:, :h.shape[1] - k] * np.uint64(pow(int(_M2), k, 1 << 64))


class Vocabulary:
    """Pieces of a SentencePiece model as text, their weights and bytes."""

    def __init__(self, path: str, sharpness: float):
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.ids, self.weight, self.data, self.byte_id = {}, [0.0] * n, [b""] * n, [0] * 256
        rank = 0
        for i in range(n):
            name = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(name[3:5], 16)
                self.byte_id[value], self.data[i] = i, bytes([value])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                text = name.replace("▁", " ")
                self.ids[text], self.data[i] = i, text.encode()
                self.weight[i] = 1.0 / (rank + 2) ** sharpness
                rank += 1
        self.byte_weight = 1.0 / (rank + 2) ** sharpness
        self.longest = max(map(len, self.ids), default=1)
        if any(" " in t.lstrip(" ") for t in self.ids):
            raise ValueError("pieces with spaces after other characters are not supported")
        self.alone = {t for t in self.ids if len(t) == 1}
        # pieces by hash: tables, each for those whose place in the one before is taken
        texts = list(self.ids)
        h = np.array([_windows(_codes([t], len(t)), len(t))[0, 0] for t in texts], np.uint64)
        own = np.array([self.ids[t] for t in texts], np.int32)
        self.tables = []
        for shift in _SHIFTS:
            place = (h >> np.uint64(shift)) & np.uint64((1 << _SLOTS) - 1)
            _, first = np.unique(place, return_index=True)
            keys, ids = np.zeros(1 << _SLOTS, np.uint64), np.full(1 << _SLOTS, -1, np.int32)
            keys[place[first]], ids[place[first]] = h[first], own[first]
            self.tables.append((np.uint64(shift), keys, ids))
            rest = np.setdiff1d(np.arange(len(h)), first)
            h, own = h[rest], own[rest]
        if len(h):
            raise ValueError("piece hashes collide")
        self.weights = np.array([*self.weight, 0.0])  # -1: no piece
        apart = "" if any("\n" in t for t in self.ids) else "\n"
        self.unit = re.compile(rf" *[^ {apart}]+|\n| +")

    def find(self, h: np.ndarray) -> np.ndarray:
        """Ids of the pieces with these hashes, -1 for none."""
        out = np.full(h.shape, -1, np.int32)
        for shift, keys, ids in self.tables:
            at = ((h >> shift) & np.uint64((1 << _SLOTS) - 1)).astype(np.intp)
            np.copyto(out, ids[at], where=keys[at] == h)
        return out

    def spell(self, ids) -> bytes:
        """The text of some pieces as UTF-8."""
        return b"".join(map(self.data.__getitem__, ids))[1:]

    def decode(self, ids) -> str:
        return self.spell(ids).decode()


class Lattices:
    """Forward-filtered lattices of units as flat arrays: node ``k`` has the
    edges whose ``high`` lies in (k, k + 1], cumulated probabilities on top of
    k; each edge has its piece and the node it comes from."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.high, self.piece, self.back = np.empty(0), np.empty(0, np.int32), np.empty(0, np.int32)
        self.first = np.empty(0, np.int32)  # first edge by node
        self.clear()

    def clear(self):
        self.known, self.n, self.nodes = {}, 0, 0  # known: numbers of units
        self.zero, self.end = array("q"), array("q")  # first and last node by number
        for name in ("high", "piece", "back", "first"):
            old = getattr(self, name)
            if len(old) != _ROOM:  # kept from then on; pages take memory once they are written
                setattr(self, name, np.empty(_ROOM, old.dtype))

    def add(self, units: list[str]):
        """Give each unit (start node, end node)."""
        alone, slow, by_width = self.v.alone, [], {}
        for u in units:
            width = next((w for w in _WIDTHS if len(u) <= w), 0)
            if width and alone.issuperset(u):
                by_width.setdefault(width, []).append(u)
            else:
                slow.append(u)
        for width, own in by_width.items():
            size = max(1, _CELLS // width)
            for i in range(0, len(own), size):
                self._add_many(own[i:i + size], width)
        if slow:
            self._add_each(slow)

    def _keep(self, high, piece, back, node, nodes):
        """More edges, each with its node; ``nodes`` is the number of nodes now."""
        m = self.n + len(high)
        for name, size in (("high", m), ("piece", m), ("back", m), ("first", nodes)):
            old = getattr(self, name)
            if size > len(old):  # a quarter more than asked for, so that copies stay few; one array after the other
                new = np.empty(size + size // 4, old.dtype)
                new[:len(old)] = old
                setattr(self, name, new)
        self.high[self.n:m], self.piece[self.n:m], self.back[self.n:m] = high, piece, back
        own = np.bincount(node - self.nodes, minlength=nodes - self.nodes)
        self.first[self.nodes:nodes] = self.n + np.cumsum(own) - own
        self.n, self.nodes = m, nodes

    def _add_many(self, units: list[str], width: int):
        """Units of at most ``width`` characters that all are pieces: the
        forward pass over all of them at once."""
        v, n = self.v, len(units)
        reach = min(v.longest, width)
        h = _prefixes(_codes(units, width))
        ids = np.full((n, width + 1, reach), -1, np.int32)  # by end and length
        for k in range(1, reach + 1):
            ids[:, k:, k - 1] = v.find(_windows(None, k, h))
        sizes = np.array([len(u) for u in units])
        ids[np.arange(width + 1)[None, :] > sizes[:, None]] = -1
        share = v.weights[ids]
        alpha = np.zeros((n, width + 1))
        alpha[:, 0] = 1
        for end in range(1, width + 1):
            k = min(reach, end)
            share[:, end, :k] *= alpha[:, end - 1:end - k - 1 if end > k else None:-1]
            alpha[:, end] = share[:, end].sum(1)
        np.cumsum(share, axis=2, out=share)
        unit, end, k = np.nonzero(ids >= 0)
        zero = self.nodes + np.cumsum(sizes + 1) - (sizes + 1)
        node = zero[unit] + end
        high = np.minimum(share[unit, end, k] / share[unit, end, -1], 1.0) + node
        high[np.append(node[1:] != node[:-1], True)] = node[np.append(node[1:] != node[:-1], True)] + 1.0
        self._keep(high, ids[unit, end, k], node - k - 1, node, self.nodes + int((sizes + 1).sum()))
        self.known.update(zip(units, range(len(self.zero), len(self.zero) + n), strict=True))
        self.zero.frombytes(zero.astype(np.int64).tobytes())
        self.end.frombytes((zero + sizes).astype(np.int64).tobytes())

    def _add_each(self, units: list[str]):
        """Units of any length and characters, one after the other."""
        v, high, piece, back, node, upto = self.v, [], [], [], [], self.nodes
        ids, weight, longest = v.ids, v.weight, v.longest
        for unit in units:
            zero = upto
            at = [zero]  # node of each character position
            nodes = zero + 1
            alpha = [1.0]
            for end in range(1, len(unit) + 1):
                total, found = 0.0, []
                for start in range(max(0, end - longest), end):
                    i = ids.get(unit[start:end])
                    if i is not None:
                        w = alpha[start] * weight[i]
                        total += w
                        found.append((total, i, at[start]))
                if unit[end - 1:end] not in ids:  # a chain of byte pieces
                    own = unit[end - 1].encode()
                    before = at[end - 1]
                    for value in own[:-1]:
                        high.append(nodes + 1.0)
                        piece.append(v.byte_id[value])
                        back.append(before)
                        node.append(nodes)
                        before, nodes = nodes, nodes + 1
                    total += alpha[end - 1] * v.byte_weight ** len(own)
                    found.append((total, v.byte_id[own[-1]], before))
                for t, i, b in found[:-1]:
                    high.append(nodes + t / total)
                    piece.append(i)
                    back.append(b)
                high.append(nodes + 1.0)
                piece.append(found[-1][1])
                back.append(found[-1][2])
                node += [nodes] * len(found)
                at.append(nodes)
                nodes += 1
                alpha.append(total)
                if total < 1e-200:  # only ratios within reach of a piece matter
                    alpha[-longest:] = [a * 1e200 for a in alpha[-longest:]]
            self.known[unit] = len(self.zero)
            self.zero.append(zero)
            self.end.append(nodes - 1)
            upto = nodes
        self._keep(high, piece, back, np.array(node, np.int64), upto)

    def sample(self, seeds: np.ndarray, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of the texts end to end and the number of each text."""
        units = [self.v.unit.findall(" " + t) if t else [] for t in texts]
        if len(self.known) > _UNITS or self.n > _EDGES:
            self.clear()
        new = [u for u in dict.fromkeys(chain.from_iterable(units)) if u not in self.known]
        if new:
            self.add(new)
        sizes = np.array([len(us) for us in units], np.int64)
        which = np.fromiter(map(self.known.__getitem__, chain.from_iterable(units)), np.int64, int(sizes.sum()))
        for u in new:
            if len(u) > _LONG:
                del self.known[u]
        if not len(which):
            return np.empty(0, np.int32), sizes
        zero, node = np.array(self.zero)[which], np.array(self.end)[which]
        first = np.repeat(np.cumsum(sizes) - sizes, sizes)
        own = mix(np.repeat(seeds, sizes) + (np.arange(len(node)) - first).astype(np.uint64) * _M1)
        live = np.arange(len(node))
        steps, step = [], 0
        high, piece, back, first_edge = self.high, self.piece, self.back, self.first
        count = np.zeros(len(node), np.int64)
        while len(live):
            u = (mix(own[live] + np.uint64(step * int(_M3) & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(11)) * 2.0 ** -53
            # u < 1; the sum may round up to the next node's number
            point = np.minimum(node + u, np.nextafter(node + 1.0, 0))
            edge = first_edge[node]
            past = np.flatnonzero(high[edge] <= point)
            while len(past):  # a node has few edges
                edge[past] += 1
                past = past[high[edge[past]] <= point[past]]
            steps.append((live, piece[edge]))
            count[live] += 1
            node = back[edge]
            more = node != zero[live]
            live, node = live[more], node[more]
            step += 1
        past = np.cumsum(count)
        out = np.empty(int(past[-1]), np.int32)
        for k, (drawn, ids) in enumerate(steps):  # from the end
            out[past[drawn] - 1 - k] = ids
        return out, np.add.reduceat(np.append(count, 0), np.minimum(np.cumsum(sizes) - sizes, len(count))) * (sizes > 0)


_LOADED: dict = {}


def _lattices(path: str, sharpness: float) -> Lattices:
    if (path, sharpness) not in _LOADED:
        _LOADED[path, sharpness] = Lattices(Vocabulary(path, sharpness))
    return _LOADED[path, sharpness]


def _seeds(keys: pa.Array, seed: int) -> np.ndarray:
    start = np.uint64(seed * 2 + 1) * _M2
    return np.array([mix(np.uint64(0xFFFFFFFF) * _M3 + start) if k is None else mix(np.uint64(k & 0xFFFFFFFFFFFFFFFF) * _M1 + start) for k in keys.to_pylist()], np.uint64)


def _sampled(documents: DataFrame, model, seed, sharpness, key, columns, out, checked) -> DataFrame:
    path = model or default_model()
    keep = documents.columns if columns is None else columns
    given = documents.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.xxhash64(F.col(key)).alias("seed"), text_or_empty().alias("text"))
    # a text that is among the columns kept goes to the workers once
    inside = next((i for i, f in enumerate(given.schema["row"].dataType.fields) if f.name.lower() == "text" and f.dataType == StringType()), None)
    if inside is not None:
        given = given.drop("text")

    def run(batches):
        from qtemplates.llm import pieces as own  # the worker's memory of units
        lattices = own._lattices(path, sharpness)
        for batch in batches:
            every_text = batch.column("text") if inside is None else pc.fill_null(batch.column("row").field(inside), "")
            i, sizes = 0, pc.utf8_length(every_text).to_numpy(zero_copy_only=False)
            while i < batch.num_rows:  # parts of a batch, so that little is held at once
                j = i + max(1, int(np.searchsorted(np.cumsum(sizes[i:]), _CHUNK, "right")))
                part, texts, i = batch.slice(i, j - i), every_text.slice(i, j - i).to_pylist(), j
                ids, n = lattices.sample(_seeds(part.column("seed"), seed), texts)
                ends = np.cumsum(n)
                cols = [part.column("row"), pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(ids))]
                if checked:
                    every = ids.tolist()
                    said = [lattices.v.spell(every[e - m:e]) for e, m in zip(ends.tolist(), n.tolist(), strict=True)]
                    cols += [pa.array([hashlib.sha256(t).hexdigest() for t in said]), pa.array([a == b.encode() for a, b in zip(said, texts, strict=True)])]
                yield pa.RecordBatch.from_arrays(cols, names=["row", "pieces", "sha256", "lossless"][:len(cols)])

    fields = [StructField("row", given.schema["row"].dataType), StructField("pieces", ArrayType(IntegerType()))]
    if checked:
        fields += [StructField("sha256", StringType()), StructField("lossless", BooleanType())]
    done = given.mapInArrow(run, StructType(fields))
    more = [F.col("sha256").alias("decoded_sha256"), F.col("lossless")] if checked else []
    return done.select("row.*", F.col("pieces").alias(out), *more)


def encode(documents: DataFrame, model: str | None = None, seed: int = SEED, sharpness: float = SHARPNESS, key: str = "doc_id", out: str = "pieces") -> DataFrame:
    """All rows and columns plus ``out``, the sampled piece ids of ``text``."""
    return _sampled(documents, model, seed, sharpness, key, None, free_name(documents, out), False)


def encode_checked(documents: DataFrame, model: str | None = None, seed: int = SEED, sharpness: float = SHARPNESS, key: str = "doc_id") -> DataFrame:
    """The key, the sampled ``pieces`` and, of the text decoded from them,
    ``decoded_sha256`` and whether it is the text given (``lossless``)."""
    return _sampled(documents, model, seed, sharpness, key, [key], "pieces", True)


def decode(rows: DataFrame, pieces: str = "pieces", model: str | None = None, out: str = "decoded") -> DataFrame:
    """All rows and columns plus ``out``, the text of the piece ids."""
    path = model or default_model()
    name = free_name(rows, out)
    given = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), F.col(pieces).alias("pieces"))

    def run(batches):
        from qtemplates.llm import pieces as own
        v = own._lattices(path, SHARPNESS).v
        for batch in batches:
            ids = batch.column("pieces")
            text = [None if p is None else v.decode(p) for p in (x.as_py() if x is None else x.values.to_numpy().tolist() if x.is_valid else None for x in ids)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(text, pa.string())], names=["row", "text"])

    schema = StructType([StructField("row", given.schema["row"].dataType), StructField("text", StringType())])
    return given.mapInArrow(run, schema).select("row.*", F.col("text").alias(name))
