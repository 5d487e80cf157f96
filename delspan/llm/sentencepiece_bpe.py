"""Operator 9: exact encoding and decoding with a merge-type (BPE) sentencepiece model.

The sentencepiece library only serves to read the model file. Encoding is done by backtracking over the
longest matches of an Aho-Corasick automaton. A sequence of pieces is the encoding of a text exactly when
merging any two neighbours' text anew gives these two pieces again; so the search takes the longest piece
that is compatible with the piece before it, and goes back where no piece fits. Because the encoding of a
prefix is unique, a position from which the search had to go back never needs another visit: a bitfield
keeps these positions.

Texts are cut at places that no piece spans (before spaces, between letters and other characters), which is
checked against the vocabulary when the model is loaded. The encoding of a text is the concatenation of its
chunks' encodings, so each worker keeps the results of recent chunks.

Defined results: a null text counts as the empty text; the empty text has no ids and decodes to the empty text.
Characters outside the vocabulary become byte pieces. Rows are treated one by one: repeated rows give repeated
results, an empty table an empty result, and other columns are not looked at.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEPT, keep_only, lean

codecs.register_error("replace-each-byte", lambda e: ("\ufffd" * (e.end - e.start), e.end))
SPACE = "▁"
NORMAL, BYTE = 1, 6
def chunk_pattern(odd: str = "") -> re.Pattern:
    """A run of spaces with what follows: letters, or other characters. odd: word characters that count as others."""
    odd = "".join(re.escape(c) for c in sorted(odd))
    return re.compile(rf"{SPACE}*(?:(?:(?![{SPACE}{odd}])[^\W\d_])+|(?:(?!{SPACE})[\W\d_{odd}])+|$)")


#: The same cut before spaces only, for vocabularies whose pieces mix letters and other characters.
CHUNK_AT_SPACES = re.compile(rf"{SPACE}*(?:[^{SPACE}]+|$)")
CACHE_CHUNKS = 100_000
CACHE_PAIRS = 300_000
OUT_CHARS = 2_000_000


class PieceModel:
    """A BPE sentencepiece model with byte fallback, identity normalisation and a leading space."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or not norm.add_dummy_prefix:
            raise ValueError("only BPE models with identity normalisation and a leading space are supported")
        if any(p.type not in (NORMAL, BYTE, 2, 3) for p in proto.pieces):
            raise ValueError("models with user-defined or unused pieces are not supported")
        self.pieces = [p.piece for p in proto.pieces]
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        self.score = {p.piece: p.score for p in proto.pieces if p.type == NORMAL}
        self.byte_id = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        self.silent = {i for i, p in enumerate(proto.pieces) if p.type == 3}
        self.known = frozenset("".join(self.ids))
        #: What each id reads as. Bytes below 128 are characters whatever stands beside them; the others need their neighbours.
        self.text = ["" if i in self.silent else chr(self.byte_of[i]) if self.byte_of.get(i, 128) < 128 else p for i, p in enumerate(self.pieces)]
        self.wide = frozenset(i for i, b in self.byte_of.items() if b >= 128)
        self.traces: dict[int, tuple[list[tuple[float, str]], list[tuple[float, str]]] | None] = {}
        if len(self.byte_id) != 256:
            raise ValueError("the model has no byte pieces")
        if any(c not in self.ids for piece in self.ids for c in piece):
            raise ValueError("a piece has a character that is no piece")
        one = lambda rx: all(rx.findall(p)[:1] == [p] for p in self.ids)
        mixed = chunk_pattern("".join(c for c in {*"".join(self.ids)} if not c.isalpha() and re.match(r"[^\W\d_]", c)))
        self.chunk = mixed if one(mixed) else CHUNK_AT_SPACES
        if not one(self.chunk):
            raise ValueError("pieces span places before spaces")
        self.matcher = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            self.matcher.add_word(piece, (len(piece) - 1, i))
        self.matcher.make_automaton()
        self.size = [len(p) for p in self.pieces]
        #: The longest piece that each piece begins with, itself apart; -1 for none.
        self.shorter = [next((self.ids[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in self.ids), -1) for p in self.pieces]
        self.fits: dict[int, bool] = {}
        self.young: dict[str, tuple] = {}
        self.old: dict[str, tuple] = {}

    def remerge(self, text: str) -> list[str]:
        """The library's definition: merge the best-scored adjacent pair, leftmost first, until none is a piece."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = self.score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def trace(self, piece: int) -> tuple[list[tuple[float, str]], list[tuple[float, str]]] | None:
        """How a piece comes about from its characters: the score of each merge with the leftmost (rightmost) part before
        it, and at the end a score below all others with the whole piece. None if merging doesn't give the piece."""
        if piece not in self.traces:
            parts = list(self.pieces[piece])
            first, last = [], []
            while len(parts) > 1:
                best, at = None, -1
                for k in range(len(parts) - 1):
                    s = self.score.get(parts[k] + parts[k + 1])
                    if s is not None and (best is None or s > best):
                        best, at = s, k
                if best is None:
                    break
                first.append((best, parts[0]))
                last.append((best, parts[-1]))
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            end = (float("-inf"), parts[0])
            self.traces[piece] = ([*first, end], [*last, end]) if len(parts) == 1 else None
        return self.traces[piece]

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the two pieces' joined text anew gives them back; left -1: the right piece alone.

        The merges inside the two pieces take place in the order of their scores, the left one first on ties; the
        pieces fit if at no time a merge across their border scores higher (or as high, and stands further left).
        """
        key = (left + 1) << 32 | right
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) >= CACHE_PAIRS:
                self.fits.clear()
            known = self.fits[key] = self._fit(left, right)
        return known

    def _fit(self, left: int, right: int) -> bool:
        b = self.trace(right)
        if left < 0 or b is None:
            return b is not None
        a = self.trace(left)
        if a is None:
            return False
        ends, begins, score = a[1], b[0], self.score
        i = k = 0
        while True:
            (s, x), (t, y) = ends[i], begins[k]
            across = score.get(x + y)
            if across is not None and across > s and across >= t:
                return False
            if i + 1 == len(ends) and k + 1 == len(begins):
                return True
            if s >= t and i + 1 < len(ends):
                i += 1
            else:
                k += 1

    def backtrack(self, text: str) -> list[int]:
        """The ids of a text of known characters."""
        n = len(text)
        longest = [-1] * n
        for end, (before, piece) in self.matcher.iter(text):  # by end: the last match of a start is its longest
            longest[end - before] = piece
        shorter, size, fits, compatible = self.shorter, self.size, self.fits, self.compatible
        failed: bytearray | None = None  # the bitfield; most texts never need it
        ids: list[int] = []
        at, last = 0, -1
        piece = longest[0]
        while at < n:
            while piece >= 0:
                known = fits.get((last + 1) << 32 | piece)
                if (known or known is None and compatible(last, piece)) and (failed is None or not failed[at + size[piece]]):
                    break
                piece = shorter[piece]
            if piece >= 0:
                ids.append(piece)
                at += size[piece]
                last = piece
                piece = longest[at] if at < n else -1
                continue
            if not ids:
                raise AssertionError(f"no encoding of {text[:80]!r}")
            if failed is None:
                failed = bytearray(n + 1)
            failed[at] = 1
            piece = ids.pop()
            at -= size[piece]
            piece = shorter[piece]
            last = ids[-1] if ids else -1
        return ids

    def encode_chunk(self, chunk: str) -> list[int]:
        if self.known.issuperset(chunk):
            return self.backtrack(chunk)
        out: list[int] = []
        known = ""
        for c in chunk:  # no piece has an unknown character, so nothing merges across it
            if c in self.ids:
                known += c
                continue
            out += self.backtrack(known) if known else []
            known = ""
            out += [self.byte_id[b] for b in c.encode()]
        return out + (self.backtrack(known) if known else [])

    def chunks(self, text: str) -> list[str]:
        return self.chunk.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        young, old = self.young, self.old
        for chunk in self.chunks(text or ""):
            ids = young.get(chunk)
            if ids is None:
                if not chunk:
                    continue
                ids = old.get(chunk)
                if ids is None:
                    ids = tuple(self.encode_chunk(chunk))
                if len(young) >= CACHE_CHUNKS:
                    self.old = old = young
                    self.young = young = {}
                if len(chunk) <= 64:
                    young[chunk] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        """Pieces joined, byte runs read as UTF-8 (each byte that doesn't belong to a character as U+FFFD), the leading space dropped."""
        if not ids:
            return ""
        if self.wide.isdisjoint(ids):
            table = self.text
            text = "".join([table[i] for i in ids])
        else:
            text = self._decode_bytes(ids)
        text = text.replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text

    def _decode_bytes(self, ids: list[int]) -> str:
        out: list[str] = []
        run = bytearray()
        for i in ids:
            b = self.byte_of.get(i)
            if b is not None:
                run.append(b)
                continue
            if run:
                out.append(run.decode("utf-8", "replace-each-byte"))
                run = bytearray()
            out.append(self.text[i])
        if run:
            out.append(run.decode("utf-8", "replace-each-byte"))
        return "".join(out)


_loaded: dict[str, PieceModel] = {}
KEPT["pieces"] = _loaded.clear


def load(path: str) -> PieceModel:
    """The model, read once in each worker."""
    if path not in _loaded:
        _loaded[path] = PieceModel(path)
    return _loaded[path]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode_decode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """``doc_id``, ``ids array<int>`` and ``decoded string`` (the text that the ids decode to) for each row."""
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only("pieces")
        bpe = load(path)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            start, held, ids, decoded = 0, 0, [], []
            for k in range(batch.num_rows):
                own = bpe.encode(texts[k].as_py())
                ids.append(own)
                decoded.append(bpe.decode(own))
                held += len(decoded[-1])
                if held >= OUT_CHARS or k + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([keys.slice(start, k + 1 - start), pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])
                    start, held, ids, decoded = k + 1, 0, [], []

    key = dict(df.dtypes)[id_col]
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(run), f"doc_id {key}, ids array<int>, decoded string")


def encoding_digests(df: DataFrame) -> DataFrame:
    """The digests of what :func:`encode_decode` returns."""
    return encode_decode(df).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
