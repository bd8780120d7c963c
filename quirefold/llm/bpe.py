"""BPE encoding and decoding with word ends, and tree concatenation for long unsplit text.

Texts fall at ASCII white space, and where ASCII letters, digits and marks meet, into chunks that encode on their own;
the library encodes a distinct chunk once (see chunktable).  A pre-token longer than LEAF characters would be one long
merge problem; it is cut into leaves that encode independently (all leaves of a batch in one parallel call), and neighbours are
then concatenated level by level.  A join re-encodes a window of tokens on both sides of the seam and grows it until the
outermost tokens of the window come back unchanged on both sides: neighbouring tokens of a BPE encoding depend on each
other only pairwise, so the concatenation is then the encoding of the whole.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import wordhash as W
from .chunktable import ChunkTable, turns
from .common import slices, texts, tidy, tune

#: Characters of a leaf, and tokens of the first window on each side of a seam.
LEAF, WINDOW = 512, 8
#: Bytes of text that are encoded together.
SLICE = 1 << 20
_PLACE = 0xE000  # a last byte's own character, so that the merges need no word-end rule


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class TreeEncoder:
    """Encodes one long pre-token, given in the byte alphabet, by its vocabulary and merges."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str = "</w>") -> None:
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        def own(token: str) -> str:
            if suffix and token.endswith(suffix) and len(token) > len(suffix):
                token = token[: -len(suffix)]
                return token[:-1] + chr(_PLACE + ord(token[-1]))
            return token

        self.suffix = suffix
        self.texts = {i: own(t) for t, i in vocab.items()}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        self.model = Tokenizer(BPE({own(t): i for t, i in vocab.items()}, [(own(a), own(b)) for a, b in pairs]))

    def _encode(self, parts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.model.encode_batch(parts, add_special_tokens=False)]

    def encode(self, piece: str, leaf: int = LEAF, window: int = WINDOW) -> list[int]:
        if not piece:
            return []
        if self.suffix:
            piece = piece[:-1] + chr(_PLACE + ord(piece[-1]))
        level = self._encode([piece[k : k + leaf] for k in range(0, len(piece), leaf)])
        while len(level) > 1:
            level = self._join(level, window)
        return level[0]

    def _join(self, level: list[list[int]], window: int) -> list[list[int]]:
        """Concatenate neighbours in pairs; all windows of a round go into one call."""
        out = [None] * (len(level) // 2) + ([level[-1]] if len(level) % 2 else [])
        open_, size = list(range(len(level) // 2)), window
        while open_:
            sides = [(level[2 * k], level[2 * k + 1]) for k in open_]
            again = self._encode(["".join(self.texts[i] for i in a[-size:] + b[:size]) for a, b in sides])
            rest = []
            for k, (a, b), new in zip(open_, sides, again):
                left, right = len(a) <= size or new[0] == a[-size], len(b) <= size or new[-1] == b[size - 1]
                if left and right:
                    out[k] = a[:-size] + new + b[size:]
                else:
                    rest.append(k)
            open_, size = rest, size * 2
        return out


class WordEncoder:
    """Whole texts to ids and back to text, as the tokenizers library's encode and decode give them."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = t = Tokenizer.from_file(path)
        t.no_padding()
        t.no_truncation()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.tree = TreeEncoder(model["vocab"], model["merges"], model.get("end_of_word_suffix") or "")
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.cut_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words = {i: t.id_to_token(i) for i in range(t.get_vocab_size(with_added_tokens=True))}
        self.dtype = np.dtype("<u2") if len(self.words) <= 1 << 16 else np.dtype("<u4")
        before = spec.get("pre_tokenizer") or {}
        patterns = [x["pattern"].get("Regex") for x in before.get("pretokenizers", []) if x.get("type") == "Split" and x.get("invert")]
        plain = all(not re.search(r"\s", x) for x in self.special) and not any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in spec["added_tokens"])
        #: Only a pre-tokenizer that keeps runs of letters, single numbers and runs of marks apart allows chunks.
        self.chunked = plain and patterns == [_PATTERN] and not t.decoder
        self.marks = [x.encode() for x in self.special]
        self.table = ChunkTable(self._pairs, self.dtype, np.uint8)

    def decode(self, ids: list[int]) -> str:
        """The vocabulary file names no decoder: tokens joined by spaces."""
        return " ".join(self.words[i] for i in ids)

    def _long(self, chunk: str) -> list[int]:
        ids: list[int] = []
        for part in self.cut_special.split(chunk) if self.cut_special else [chunk]:
            if part in self.special:
                ids.append(self.special[part])
            elif part:
                text = self.tokenizer.normalizer.normalize_str(part) if self.tokenizer.normalizer else part
                for piece, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text):
                    ids += self.tree.encode(piece) if len(piece) > LEAF else [t.id for t in self.tokenizer.model.tokenize(piece)]
        return ids

    def _pairs(self, chunks: list[str]) -> list[tuple[bytes, bytes]]:
        """(ids, decoded text and a space behind it) of each."""
        short = [k for k, c in enumerate(chunks) if len(c) <= LEAF or not self.chunked]
        ids: list[list[int]] = [[]] * len(chunks)
        for k, e in zip(short, self.tokenizer.encode_batch_fast([chunks[k] for k in short], add_special_tokens=False)):
            ids[k] = e.ids
        if len(short) < len(chunks):
            for k, c in enumerate(chunks):
                if len(c) > LEAF and self.chunked:
                    ids[k] = self._long(c)
        return [(np.array(x, self.dtype).tobytes(), self.decode(x).encode() + b" " if x else b"") for x in ids]

    def runs(self, column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(first row, last row + 1, ids of these rows, bounds of each row's; decoded bytes with a space after each chunk, their bounds)."""
        for at, to, data, offsets in slices(column, SLICE):
            if self.chunked:
                starts, ends, _ = W.word_bounds(data, offsets)
                inside = np.flatnonzero(turns(data, self.marks))
                starts, ends = np.sort(np.concatenate([starts, inside])), np.sort(np.concatenate([ends, inside]))
            else:
                full = np.diff(offsets) > 0
                starts, ends = offsets[:-1][full], offsets[1:][full]
            places = self.table.lookup(data, starts, ends)
            first = np.searchsorted(starts, offsets)
            out = [at, to]
            for store in self.table.results:
                flat, bounds = store.take(places)
                out += [flat, bounds[first]]
            yield tuple(out)

    def encode(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """(ids as bytes, decoded text) of each."""
        out = []
        for _, _, ids, a, text, b in self.runs(pa.array(texts, pa.large_string())):
            out += [(ids[a[k] : a[k + 1]].tobytes(), text[b[k] : max(b[k], b[k + 1] - 1)].tobytes().decode()) for k in range(len(a) - 1)]
        return out


#: The pattern of the pre-tokenizer that texts can be cut for: fixed by the format of word_bpe files.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


SCHEMA = "doc_id long, n_tokens long, ids binary, decoded string"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_texts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """Per document the ids (little-endian, unsigned, 32 bits) and the text they decode to, or only their digests.

    No shuffle.  Null and empty texts have no ids and decode to the empty text; repeated rows stay repeated.
    """
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(tokenizer_path)
        names = [c.split()[0] for c in (DIGESTS if digests else SCHEMA).split(", ")]
        for batch in batches:
            for at, to, ids, a, text, b in code.runs(batch.column(1)):
                wide, n = ids.astype("<u4"), np.diff(a)
                stops = np.maximum(b[:-1], b[1:] - 1)  # without the space at the end
                if digests:
                    words, chars = memoryview(wide).cast("B"), memoryview(text)
                    columns = [[hashlib.sha256(words[4 * x : 4 * y]).hexdigest() for x, y in zip(a[:-1].tolist(), a[1:].tolist())], [hashlib.sha256(chars[x:y]).hexdigest() for x, y in zip(b[:-1].tolist(), stops.tolist())]]
                    columns = [pa.array(c, pa.string()) for c in columns]
                else:
                    columns = [pa.array([wide[x:y].tobytes() for x, y in zip(a[:-1], a[1:])], pa.binary()), pa.array([text[x:y].tobytes().decode() for x, y in zip(b[:-1], stops)], pa.string())]
                yield pa.record_batch([batch.column(0).slice(at, to - at), pa.array(n), *columns], names=names)

    return texts(docs, id_col, text_col).mapInArrow(tidy(run), DIGESTS if digests else SCHEMA)
