"""Encoding and decoding with a SentencePiece BPE model by streaming Viterbi.

The vocabularies at hand are BPE models, whose best segmentation is the one that merging by rank ends in, not the one of
the greatest sum of scores. The dynamic programme is therefore that of BPE: every prefix of a text has one encoding, and
its last piece t is the one that may follow the last piece of the prefix before t. Two pieces may follow one another if
merging never joins across their border. So each position keeps a back pointer, as in Viterbi's algorithm, and a piece
reaches back no further than the longest one: only back pointers within this window can still be used. When the paths
from all of them meet in one boundary, the ids before it are final and are handed out; a text is never held as a lattice.

A piece holds spaces only at its start, so that paths always meet before a space that follows other characters: there a
stream ends and the next one begins. Words repeat, and the ids of short ones are remembered in a table of bounded size.

Defined results: a null text gives null ids, an empty one none; a character that the model lacks becomes the pieces of
its UTF-8 bytes; so does U+2581, which stands for a space in the model, so that decoding gives each text back exactly.
Otherwise ids equal those of the sentencepiece library. An empty table gives an empty result. Repeated rows, and null or
repeated ids, are encoded like any others. Only the named text column is read. A column that has the name of a new one is
replaced by it; if it is the text or the ids that are read, they are read first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Words whose ids a worker remembers, in each of two generations.
REMEMBERED = 100_000
#: Pieces before a piece for which a worker remembers whether it may follow.
LEFT_REMEMBERED = 500
#: Longer units aren't remembered.
LONGEST_WORD = 48
#: Positions after which a stream looks for a boundary where its paths meet.
LOOK = 64


def load_model(path: str = MODEL) -> dict:
    """What the coder needs of a model file, as plain values: pieces with ids and scores, and the byte pieces."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(m.get_piece_size())
    plain = {m.id_to_piece(i): (i, m.get_score(i)) for i in ids if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))}
    bytes_ = {int(m.id_to_piece(i)[3:5], 16): i for i in ids if m.is_byte(i)}
    if len(bytes_) != 256:
        raise ValueError("the model must hold a piece for each byte")
    if any(SPACE in p.lstrip(SPACE) for p in plain):
        raise ValueError("pieces with a space after other characters aren't supported")
    return {"pieces": plain, "bytes": [bytes_[b] for b in range(256)]}


class Coder:
    """Encodes and decodes with one model."""

    def __init__(self, model: dict):
        self.pieces = {p: i for p, (i, _) in model["pieces"].items()}
        self.texts = {i: p for p, i in self.pieces.items()}
        self.byte_ids = model["bytes"]
        order = sorted({s for _, s in model["pieces"].values()}, reverse=True)
        rank_of = {s: r for r, s in enumerate(order)}
        self.rank = {p: rank_of[s] for p, (_, s) in model["pieces"].items()}
        self.longest = max(map(len, self.pieces))
        self._sides: dict[str, tuple] = {}
        self._known: dict[str, tuple[int, ...]] = {}
        self._older: dict[str, tuple[int, ...]] = {}
        # characters that no piece of two or more holds never join; a text may be cut around them
        joined = {c for p in self.pieces if len(p) > 1 for c in p}
        self._cut = re.compile("([^" + re.escape("".join(sorted(joined - {SPACE}))) + "])")
        # pieces that merging can end in, read backwards as a tree; "" marks an end
        self.tree: dict = {}
        self.follows: dict[str, dict[str, bool]] = {}
        for p in self.pieces:
            if len(p) > 1 and self._split(p) is not None:
                self.follows[p] = {}
                node = self.tree
                for c in reversed(p):
                    node = node.setdefault(c, {})
                node[""] = (p, self.follows[p])
        self.raw = [b""] * (max(max(self.texts), max(self.byte_ids)) + 1)
        for i, p in self.texts.items():
            self.raw[i] = p.replace(SPACE, " ").encode()
        for b, i in enumerate(self.byte_ids):
            self.raw[i] = bytes([b])

    # -- merging --

    def _merge(self, text: str) -> list[tuple[str, list]]:
        """Joins adjacent pieces of a short text by rank, the leftmost first among equals; each with the parts of its last join."""
        parts: list[tuple[str, tuple]] = [(c, ()) for c in text]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.rank.get(parts[i][0] + parts[i + 1][0])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            left, right = parts[at], parts[at + 1]
            parts[at : at + 2] = [(left[0] + right[0], (left, right))]
        return parts

    def _split(self, piece: str):
        got = self._merge(piece)
        return got[0][1] if len(got) == 1 else None

    def _side(self, piece: str):
        """The pieces at the left and at the right end of a piece while it is being joined, from its first character on,
        each with the rank of the join that used it up."""
        if (have := self._sides.get(piece)) is None:
            node = self._merge(piece)[0]
            ends = []
            for side in (0, 1):
                chain, x = [(node[0], None)], node
                while x[1]:
                    chain.append((x[1][side][0], self.rank[x[0]]))
                    x = x[1][side]
                ends.append(chain[::-1])
            have = self._sides[piece] = tuple(ends)
        return have

    def fits(self, left: str, right: str) -> bool:
        """Whether merging `left` + `right` ends in these two pieces; remembered for each right one."""
        known = self.follows[right]
        if len(known) > LEFT_REMEMBERED:
            known.clear()
        have = known[left] = self._fits_now(left, right)
        return have

    def _fits_now(self, left: str, right: str) -> bool:
        a, b = self._side(left)[1], self._side(right)[0]
        i = j = 0
        never = 1 << 60
        while True:
            (x, use_x), (y, use_y) = a[i], b[j]
            use_x, use_y = never if use_x is None else use_x, never if use_y is None else use_y
            across = self.rank.get(x + y)
            if across is not None and across < use_x and across <= use_y:
                return False
            if use_x == use_y == never:
                return True
            if use_x <= use_y:
                i += 1
            else:
                j += 1

    # -- Viterbi --

    def _ids(self, piece: str) -> list[int]:
        i = self.pieces.get(piece)
        return [i] if i is not None else [self.byte_ids[b] for b in piece.encode()]

    def _last(self, unit: str, at: int, base: int, last: list[str | None]) -> str:
        """The back pointer at a position: the last piece of the encoding of unit[:at], which is the longest that ends here
        and may follow the last piece of what is before it. last[i] is that of the prefix that ends at base + i, or None
        while no path has asked for it."""
        node, k = self.tree.get(unit[at - 1]), at - 1
        ends = []
        while node is not None and k > base:
            k -= 1
            node = node.get(unit[k])
            if node is not None and (end := node.get("")) is not None:
                ends.append(end)
        found = unit[at - 1]
        while ends:
            piece, before = ends.pop()
            k = at - len(piece)
            if k == 0:
                found = piece
                break
            left = last[k - base]
            if left is None:
                left = self._last(unit, k, base, last)
            fits = before.get(left)
            if fits is None:
                fits = self.fits(left, piece)
            if fits:
                found = piece
                break
        last[at - base] = found
        return found

    def pieces_of(self, unit: str) -> Iterator[str]:
        """The pieces of a unit, streamed: those before a boundary come as soon as all paths that can go on meet there. Back
        pointers are worked out where a path passes."""
        last: list[str | None] = [""]
        base, size, limit = 0, len(unit), LOOK + self.longest
        while True:
            stop = min(size, base + limit)
            last += [None] * (stop - base + 1 - len(last))
            if stop == size:
                break
            live = set(range(stop - base - self.longest, stop - base + 1))
            while len(live) > 1:
                p = max(live)
                live.discard(p)
                live.add(p - len(last[p] or self._last(unit, base + p, base, last)))
            meet = live.pop()
            if meet > 0:
                yield from self._path(unit, meet, base, last)
                last = last[meet:]
                base, limit = base + meet, LOOK + self.longest
            else:
                limit += LOOK
        yield from self._path(unit, size - base, base, last)

    def _path(self, unit: str, at: int, base: int, last: list[str | None]) -> list[str]:
        out = []
        while at > 0:
            piece = last[at] or self._last(unit, base + at, base, last)
            out.append(piece)
            at -= len(piece)
        return out[::-1]

    # -- texts --

    def _ids_of(self, pieces) -> tuple[int, ...]:
        known, out = self.pieces, []
        for p in pieces:
            i = known.get(p)
            if i is None:
                out += self._ids(p)
            else:
                out.append(i)
        return tuple(out)

    def _remember(self, unit: str, ids: tuple[int, ...]) -> None:
        """Two generations: when the younger is full, it becomes the older, and what isn't used again goes."""
        if len(self._known) >= REMEMBERED:
            self._older, self._known = self._known, {}
        self._known[unit] = ids

    def _word(self, unit: str) -> tuple[int, ...]:
        """Ids of a word, with its leading space if it has one."""
        if (have := self._known.get(unit)) is None:
            if (have := self._older.get(unit)) is None:
                have = self._ids_of(self.pieces_of(unit))
            if len(unit) <= LONGEST_WORD:
                self._remember(unit, have)
        return have

    def _spaces(self, n: int) -> list[int]:
        """Ids of n spaces that nothing else joins: equal ranks join from the left."""
        longest = max(k for k in range(1, self.longest + 1) if SPACE * k in self.pieces)
        out = [self.pieces[SPACE * longest]] * (n // longest)
        if n % longest:
            out += [self.pieces[p] for p, _ in self._merge(SPACE * (n % longest))]
        return out

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        alone = self.pieces[SPACE]
        spaces = 0
        word = self._word
        for w in text.split(" "):
            spaces += 1
            if not w:
                continue
            unit = SPACE + w
            ids = self._known.get(unit)
            if ids is None and (ids := self._older.get(unit)) is not None:
                self._remember(unit, ids)
            if ids is None or spaces > 1:
                parts = self._cut.split(w)
                first = word(SPACE + parts[0]) if parts[0] else (alone,)
                if spaces > 1:
                    if first[0] == alone:
                        out += self._spaces(spaces)
                        first = first[1:]
                    else:
                        out += self._spaces(spaces - 1)
                ids = first
                for k in range(1, len(parts)):
                    p = parts[k]
                    if p:
                        ids += word(p) if k % 2 == 0 else tuple(self._ids(p) if p != SPACE else [self.byte_ids[b] for b in p.encode()])
                if spaces == 1 and len(w) <= LONGEST_WORD:
                    self._remember(unit, ids)
            out += ids
            spaces = 0
        if spaces:
            out += self._spaces(spaces)
        return out

    def decode(self, ids) -> str:
        raw = self.raw
        return b"".join([raw[i] for i in ids]).decode(errors="replace").removeprefix(" ")


@cache
def _coder_of(key: int) -> Coder:
    return Coder(_MODELS[key])


_MODELS: dict[int, dict] = {}


def _coder(shared) -> Coder:
    """The worker's coder for a broadcast model; made once in a worker."""
    key = shared.value["key"]
    _MODELS.setdefault(key, shared.value)
    C.worker_for("sentencepiece", _forget)
    return _coder_of(key)


def _forget() -> None:
    _coder_of.cache_clear()
    _MODELS.clear()


def _shared(spark, path: str):
    model = load_model(path)
    C.bounded(spark)
    return spark.sparkContext.broadcast(model | {"key": hash(tuple(sorted(model["pieces"].items())))})


def encode(docs: DataFrame, text: str = "text", model: str = MODEL, check: bool = False) -> DataFrame:
    """docs with `ids` (array of int). check: also `decoded_equal`, whether decoding gives the text back."""
    docs, text, added = _without(docs, text, ["ids", "decoded_equal"][: 1 + check])
    spark, names = docs.sparkSession, docs.columns
    shared = _shared(spark, model)

    def run(batches):
        import pyarrow as pa

        coder = _coder(shared)
        for whole in batches:
            for batch in C.slices(whole):
                flat: list[int] = []
                at, equal = [0], []
                texts = batch.column(names.index(text)).to_pylist()
                chunks = []
                for t in texts:
                    got = coder.encode(t) if t is not None else []
                    flat += got
                    at.append(at[-1] + len(got))
                    if check:
                        equal.append(None if t is None else coder.decode(got) == t)
                    if len(flat) > 1 << 20:
                        chunks.append(pa.array(flat, pa.int32()))
                        flat = []
                chunks.append(pa.array(flat, pa.int32()))
                lists = pa.ListArray.from_arrays(pa.array([None if texts[i] is None else at[i] for i in range(len(texts))] + at[-1:], pa.int32()), pa.concat_arrays(chunks))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists, *([pa.array(equal, pa.bool_())] if check else [])], names=[*names, *added])

    more = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded_equal", T.BooleanType())]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *more[: 1 + check]])).drop("_read")


def _without(df: DataFrame, read: str, new: list[str]) -> tuple[DataFrame, str, list[str]]:
    """df without columns that have new ones' names, the name of the column to read, and those of the new ones."""
    if read in new:
        df, read = df.withColumnRenamed(read, "_read"), "_read"
    return df.drop(*new), read, new


def decode(tokens: DataFrame, ids: str = "ids", to: str = "text", model: str = MODEL) -> DataFrame:
    """tokens with a text column made from ids; null ids give null."""
    tokens, ids, _ = _without(tokens, ids, [to])
    names = tokens.columns
    shared = _shared(tokens.sparkSession, model)

    def run(batches):
        import pyarrow as pa

        coder = _coder(shared)
        for batch in batches:
            made = [None if x is None else coder.decode(x) for x in batch.column(names.index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], names=[*names, to])

    return tokens.mapInArrow(run, T.StructType([*tokens.schema.fields, T.StructField(to, T.StringType())])).drop("_read")


def op10_sentencepiece(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode(docs, check=True).select("doc_id", "ids", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_ids"), "decoded_equal")


def stage_sentencepiece(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the ids of each document, and whether they decode to its text. A null text has null ids; a document
    that comes again is encoded again; an empty table gives an empty result; further columns aren't read."""
    return encode(docs.select("doc_id", "source", "text"), check=True).select("doc_id", "source", "ids", F.size("ids").cast("long").alias("n_ids"), "decoded_equal")
