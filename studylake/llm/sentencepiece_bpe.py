"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Encoding keeps a score-ordered agenda of adjacent symbol pairs: the pair whose joined piece has the highest score, leftmost on a tie,
is merged first, and its new neighbours join the agenda. A text is cut only where no piece of the vocabulary can span the cut, so each
chunk is merged on its own and repeated chunks are merged once a worker. Every Arrow slice is checked against the library.

Defined results: null and empty texts give no pieces (the end id alone, if asked for); characters without a piece become byte pieces;
repeated rows are encoded alike; an empty table gives an empty result. Other columns pass through.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from studylake.llm._common import map_slices

SPACE = "▁"
#: Chunks whose pieces a worker keeps; beyond that the older half goes unless it is met again.
KEPT_CHUNKS = 600_000


class Vocabulary:
    """Pieces, scores and the text rules of a BPE model file."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        model = proto.ModelProto()
        model.ParseFromString(self.library.serialized_model_proto())
        rules = model.normalizer_spec
        if model.trainer_spec.model_type != proto.TrainerSpec.BPE:
            raise ValueError(f"{path} is not a merge-type vocabulary")
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError(f"{path} normalises texts in a way that is not supported")
        kinds = proto.ModelProto.SentencePiece
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
            raise ValueError(f"{path} has user-defined or unused pieces, which are not supported")
        self.prefix = rules.add_dummy_prefix
        self.end = model.trainer_spec.eos_id
        self.unknown = model.trainer_spec.unk_id
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        #: Rank by score, highest first; equal scores have equal ranks.
        order = {x: r for r, x in enumerate(sorted({p.score for p in model.pieces if p.type == kinds.NORMAL}, reverse=True))}
        self.ranks = {p.piece: order[p.score] for p in model.pieces if p.type == kinds.NORMAL}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        #: What each id adds to a text: a string, or a byte over 7F, which needs its neighbours.
        self.surface: list[str | int] = ["" for _ in model.pieces]
        for i, p in enumerate(model.pieces):
            if p.type == kinds.NORMAL:
                self.surface[i] = p.piece
            elif p.type == kinds.BYTE:
                self.surface[i] = b if (b := int(p.piece[3:5], 16)) > 127 else chr(b)
            elif p.type == kinds.UNKNOWN:
                self.surface[i] = model.trainer_spec.unk_surface
        self.high = {i for i, x in enumerate(self.surface) if isinstance(x, int)}
        #: A chunk ends before a space mark that follows another character, unless some piece goes on there.
        self.cuts = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        #: Neighbouring characters inside pieces: between any others a chunk falls apart.
        self.inside = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.kept: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.parts: dict[str, tuple[int, ...]] = {}
        self.wrong: set[str] = set()
        self.names = list(map(str, range(len(model.pieces))))

    def merge(self, chunk: str, pairs: list[str]) -> list[int]:
        """The ids of one chunk, by the agenda; pairs: its neighbouring characters.

        A symbol is a span of the chunk: at[i] is where the one that starts at i stops, 0 once it is merged away. An entry of the agenda
        is one number: the joined piece's rank by score, its start, its length, in fields as wide as the chunk needs; so the order is by score, then
        from the left.
        """
        ranks, size = self.ranks.get, len(chunk)
        wide, mask, far = 24, 0xFFFFFF, 48
        if size > mask:
            wide = size.bit_length()
            mask, far = (1 << wide) - 1, 2 * wide
        agenda = [r << far | i << wide | 2 for i, r in enumerate(map(ranks, pairs)) if r is not None]
        if not agenda:
            return [x for c in chunk for x in self.alone(c)]
        at = list(range(1, size + 2))
        before = list(range(-1, size + 1))
        heapify(agenda)
        while agenda:
            entry = heappop(agenda)
            left = entry >> wide & mask
            stop = left + (entry & mask)
            middle = at[left]
            if at[middle] != stop or not middle:
                continue
            at[left] = stop
            at[middle] = 0
            before[stop] = left
            if stop < size:
                after = at[stop]
                if (r := ranks(chunk[left:after])) is not None:
                    heappush(agenda, r << far | left << wide | after - left)
            if left:
                ahead = before[left]
                if (r := ranks(chunk[ahead:stop])) is not None:
                    heappush(agenda, r << far | ahead << wide | stop - ahead)
        out: list[int] = []
        ids, i = self.ids.get, 0
        while i < size:
            s = chunk[i : at[i]]
            i = at[i]
            if (found := ids(s)) is not None:
                out.append(found)
            else:
                out += self.alone(s)
        return out

    def alone(self, character: str) -> list[int]:
        """The ids of a character that is not merged."""
        if (found := self.ids.get(character)) is not None:
            return [found]
        return [self.bytes[b] for b in character.encode()] if self.bytes else [self.unknown]

    def chunks(self, text: str) -> list[str]:
        if not text:
            return []
        marked = (SPACE if self.prefix else "") + text.replace(" ", SPACE)
        return re.findall(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+", marked) if self.cuts else [marked]

    def pieces(self, chunk: str) -> tuple[int, ...]:
        """The ids of one chunk, merged between the places that no piece spans; parts that were met before are not merged again."""
        inside, parts = self.inside, self.parts
        pairs = list(map(add, chunk, chunk[1:]))
        if inside.issuperset(pairs):
            return tuple(self.merge(chunk, pairs))
        cuts = [i for i, p in enumerate(pairs, 1) if p not in inside]
        out: list[int] = []
        for first, stop in zip([0, *cuts], [*cuts, len(chunk)], strict=True):
            part = chunk[first:stop]
            if (ids := parts.get(part)) is None:
                if len(parts) > KEPT_CHUNKS // 2:
                    parts.clear()
                ids = parts[part] = tuple(self.merge(part, pairs[first : stop - 1]))
            out += ids
        return tuple(out)

    def learn(self, chunks: set[str]) -> None:
        """Merge the chunks that this worker has not met, and have the library encode the same ones as a check."""
        kept, older = self.kept, self.older
        if len(kept) > KEPT_CHUNKS // 2:
            self.older, self.kept = kept, {}
            kept, older = self.kept, self.older
        new = []
        for c in chunks:
            if c not in kept:
                if (ids := older.get(c)) is None:
                    new.append(c)
                    ids = self.pieces(c)
                kept[c] = ids
        skip = int(self.prefix)
        told = [c for c in new if len(c) > skip]  # the mark alone is no text of its own
        theirs = self.library.encode([c[skip:].replace(SPACE, " ") for c in told], num_threads=1)
        self.wrong.update(c for c, ids in zip(told, theirs, strict=True) if list(kept[c]) != ids)

    def encode(self, texts: list[str], end: bool = True) -> tuple[list[list[int]], list[bool]]:
        """Ids of each text, and whether the library gives the same for all its chunks."""
        cut = [self.chunks(t) for t in texts]
        self.learn(set(chain.from_iterable(cut)))
        kept, tail = self.kept, [self.end] * end
        ids = [list(chain.from_iterable(map(kept.__getitem__, c))) + tail for c in cut]
        return ids, [not self.wrong or self.wrong.isdisjoint(c) for c in cut]

    def decode(self, ids: list[int]) -> str:
        """Pieces joined, byte pieces read as UTF-8 (U+FFFD for each byte that is not), space marks as spaces, the prefix dropped."""
        parts = map(self.surface.__getitem__, ids)
        if not self.high.isdisjoint(ids):
            joined, run = [], bytearray()
            for p in [*parts, ""]:
                if isinstance(p, int):
                    run.append(p)
                    continue
                if run:
                    joined.append(_utf8(bytes(run)))
                    run.clear()
                joined.append(p)
            parts = joined
        text = "".join(parts)
        if self.prefix and text.startswith(SPACE):
            text = text[1:]
        return text.replace(SPACE, " ")


def _utf8(raw: bytes) -> str:
    out, at = [], 0
    while at < len(raw):
        for size in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + size].decode())
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode_decode(df: DataFrame, model: str, text_col: str = "text", columns: list[str] | None = None, end: bool = True, digests: bool = False) -> DataFrame:
    """The given columns of df (all by default), then ids (array of int), decoded (their text) and agrees (the library gives the same of both).

    digests: n_tokens, ids_sha256 and decoded_sha256 stand for ids and decoded, so that id lists need not leave the worker. Columns of df
    with such names are replaced.
    """
    made_kinds = {"n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()} if digests else {"ids": T.ArrayType(T.IntegerType()), "decoded": T.StringType()}
    made_kinds["agrees"] = T.BooleanType()
    kept = [c for c in columns or df.columns if c not in made_kinds]

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        v = vocabulary(model)
        texts = [t or "" for t in part.column(0).to_pylist()]
        ids, agrees = v.encode(texts, end)
        decoded = [v.decode(i) for i in ids]
        # a text that comes back whole is decoded right; the library judges the others
        agrees = [a and (d == t or v.library.decode(i) == d) for a, i, d, t in zip(agrees, ids, decoded, texts, strict=True)]
        if digests:
            joined = [hashlib.sha256(" ".join(map(v.names.__getitem__, i)).encode()).hexdigest() for i in ids]
            made = [pa.array([len(i) for i in ids], pa.int64()), pa.array(joined, pa.string()), pa.array([hashlib.sha256(d.encode()).hexdigest() for d in decoded], pa.string())]
        else:
            offsets = np.zeros(len(ids) + 1, np.int32)
            np.cumsum([len(i) for i in ids], out=offsets[1:])
            flat = pa.array(np.fromiter(chain.from_iterable(ids), np.int32, int(offsets[-1])))
            made = [pa.ListArray.from_arrays(pa.array(offsets), flat), pa.array(decoded, pa.string())]
        return pa.RecordBatch.from_arrays([*part.columns[1:], *made, pa.array(agrees, pa.bool_())], names=fields.names)

    state = df.select(F.col(text_col).alias("__text"), *[F.col(c).alias(f"__{i}") for i, c in enumerate(kept)])
    fields = T.StructType([*state.schema.fields[1:], *[T.StructField(f"__made_{n}", t) for n, t in made_kinds.items()]])
    out = map_slices(state, 0, work, fields)
    return out.select(*[F.col(f.name).alias(c) for f, c in zip(fields, [*kept, *made_kinds], strict=True)])
