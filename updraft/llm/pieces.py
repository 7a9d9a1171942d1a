"""SentencePiece BPE by a prefix table instead of a merge queue.

For every prefix of a string the merge process ends in one last token. A token
``t`` that ends at position ``i`` is that token exactly if it is compatible with
the last token ``p`` of the prefix before it: merging ``p + t`` on its own gives
``[p, t]`` again, because a merge crossing their border would have had the same
priority there. All tokens ending at a position come from one automaton pass; the
tokens of the whole string are read backwards from the table.

Text is cut first where no vocabulary entry holds the two characters beside the
cut (checked when the model is loaded): no merge can cross such a place. Chunks
repeat, so their results are kept per worker process, as are the pair tests, within
``CACHE_BYTES`` and ``PAIRS``: a worker outlives its task and serves other stages
with whatever it still holds.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import numpy as np
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from updraft.llm.common import batch_rows, read, whole_text

#: About so much memory the chunks of a worker process take; when it is full they start anew.
CACHE_BYTES = 32 << 20
ENTRY_BYTES = 220       # of a chunk besides its characters
TOKENS = 50_000         # tokens whose ids are kept as text
PAIRS = 500_000         # pair tests kept (about 40 MB)
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
MARK = "\u2581"   # the model's own sign for a space
#: A chunk: spaces and the run of letters, of digits, of line ends or of other characters after them.
FINE = re.compile(r" *(?:[a-zA-ZÀ-ÖØ-öø-ÿ]+|\d+|\n|[^a-zA-ZÀ-ÖØ-öø-ÿ\d \n]+)| +")
COARSE = re.compile(r" *[^ ]+| +")
#: The fine cut is checked for these characters only; texts with any other use the coarse cut.
OTHER = re.compile(r"[^\x00-\x7fÀ-ÖØ-öø-ÿ]")
_MODELS: dict[str, "PieceModel"] = {}


class PieceModel:
    """Vocabulary of a SentencePiece BPE model with identity normalisation; spaces stay spaces."""

    def __init__(self, path: str):
        self.processor = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        plain = [i for i in range(size)
                 if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.ids = {sp.id_to_piece(i).replace(MARK, " "): i for i in plain}
        self.scores = {sp.id_to_piece(i).replace(MARK, " "): sp.get_score(i) for i in plain}
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.end_id = sp.eos_id()
        self.surface = {i: p.encode() for p, i in self.ids.items()}
        self.surface.update({i: bytes([b]) for b, i in enumerate(self.byte_ids)})
        self.surface_of = {str(i).encode(): piece for i, piece in self.surface.items()}
        self.automaton = ahocorasick.Automaton()
        for piece in self.ids:
            # With each piece go its known neighbours to the left: whether both stay apart.
            self.automaton.add_word(piece, (len(piece), {}, piece))
        self.automaton.make_automaton()
        self.pairs = 0
        if any(" " in p.lstrip(" ") for p in self.ids):
            raise ValueError("a piece goes on after a space: such models are not supported")
        fine = all(len(FINE.findall(p)) == 1 for p in self.ids if not OTHER.search(p))
        self.fine = FINE if fine else COARSE
        self.texts = TokenTexts(self)
        self.chunks = Chunks(self)

    def merged(self, text: str) -> list[str]:
        """Tokens of a short string by the merges themselves: best score first, leftmost on ties."""
        parts, score, none = list(text), self.scores.get, float("-inf")
        marks = [score(a + b, none) for a, b in zip(parts, parts[1:])]
        while marks:
            best = max(marks)
            if best == none:
                break
            i = marks.index(best)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            del marks[i]
            if i < len(marks):
                marks[i] = score(parts[i] + parts[i + 1], none)
            if i:
                marks[i - 1] = score(parts[i - 1] + parts[i], none)
        return parts

    def compatible(self, before: str, token: str) -> bool:
        """True if ``before`` and ``token`` stay two tokens side by side (``before`` may be empty)."""
        return self.merged(before + token) == ([before, token] if before else [token])

    def forget_pairs(self) -> None:
        for _, known, _ in self.automaton.values():
            known.clear()
        self.pairs = 0

    def tokens(self, text: str) -> list[str]:
        """Tokens of ``text`` by the prefix table.

        Longer matches come first at each end; characters outside the vocabulary
        match nothing and are tokens of their own.
        """
        last: list[str | None] = [""] + [None] * len(text)
        for end, (size, known, token) in self.automaton.iter(text):
            end += 1
            if last[end] is None:
                before = last[end - size]
                if before is None:
                    before = text[end - size - 1]
                fits = known.get(before)
                if fits is None:
                    if self.pairs >= PAIRS:
                        self.forget_pairs()
                    fits = known[before] = self.compatible(before, token)
                    self.pairs += 1
                if fits:
                    last[end] = token
        out, at = [], len(text)
        while at:
            token = last[at] or text[at - 1]
            out.append(token)
            at -= len(token)
        out.reverse()
        return out

    def split(self, text: str) -> list[str]:
        """The chunks of a text; the model's leading space is added, none for an empty text."""
        if not text:
            return []
        if not text.isascii():
            text = text.replace(MARK, " ")
            if OTHER.search(text):
                return COARSE.findall(" " + text)
        return self.fine.findall(" " + text)

    def encode(self, text: str) -> list[int]:
        """The ids of ``text`` with the end id."""
        ids = [int(i) for c in self.split(text) for i in self.chunks[c].split()]
        return [*ids, self.end_id]

    def decode(self, ids: list[int]) -> str:
        """Text of ids: surfaces joined, the leading space dropped, control ids empty."""
        joined = b"".join(self.surface.get(i, b"") for i in ids)
        return joined[joined[:1] == b" ":].decode("utf-8", "replace")


class TokenTexts(dict):
    """Per token: its ids as decimal text, each followed by a space."""

    def __init__(self, model: PieceModel):
        super().__init__()
        self.ids, self.byte_ids = model.ids, model.byte_ids

    def __missing__(self, token: str) -> bytes:
        ids = [self.ids[token]] if token in self.ids else [self.byte_ids[b] for b in token.encode()]
        value = "".join(f"{i} " for i in ids).encode()
        if len(self) < TOKENS:
            self[token] = value
        return value


class Chunks(dict):
    """As ``TokenTexts`` for chunks; one that alone would fill much of the memory is not kept."""

    def __init__(self, model: PieceModel):
        super().__init__()
        self.tokens, self.texts, self.held = model.tokens, model.texts, 0

    def __missing__(self, chunk: str) -> bytes:
        value = b"".join([self.texts[t] for t in self.tokens(chunk)])
        # A character outside of Latin-1 takes up to four bytes.
        size = ENTRY_BYTES + (1 if chunk.isascii() else 4) * len(chunk) + len(value)
        if 16 * size <= CACHE_BYTES:
            if self.held + size > CACHE_BYTES:
                self.clear()
                self.held = 0
            self[chunk] = value
            self.held += size
        return value


def model(path: str) -> PieceModel:
    """The model of this worker process; loaded once."""
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def _encoded(m: PieceModel, text: bytes) -> tuple[list[bytes], bytes]:
    """The ids of a text with the end id, as decimal text, and the decoded text."""
    ids = b"".join(map(m.chunks.__getitem__, m.split(text.decode("utf-8", "replace")))).split()
    decoded = b"".join(map(m.surface_of.__getitem__, ids))
    ids.append(str(m.end_id).encode())
    return ids, decoded[decoded[:1] == b" ":]


def _digest_row(doc_id, text: bytes, path: str) -> tuple:
    ids, decoded = _encoded(model(path), text)
    return doc_id, len(ids), hashlib.sha256(b" ".join(ids)).hexdigest(), hashlib.sha256(decoded).hexdigest()


def _id_row(doc_id, text: bytes, path: str) -> tuple:
    ids, decoded = _encoded(model(path), text)
    return doc_id, np.array(ids, np.int32), decoded.decode("utf-8", "replace")


def encode_documents(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, ids and decoded text of every document.

    Null text counts as empty: its ids are the end id alone. Repeated rows and
    null doc_ids come out as they are; other columns are not read.
    """
    rows = docs.select("doc_id", whole_text().alias("text"), F.lit(model_path).alias("path"))
    return batch_rows(rows, _id_row, "doc_id long, ids array<int>, decoded string")


def digest_documents(docs: DataFrame, model_path: str) -> DataFrame:
    """As ``encode_documents``, with counts and digests in place of ids and text."""
    rows = docs.select("doc_id", whole_text().alias("text"), F.lit(model_path).alias("path"))
    return batch_rows(rows, _digest_row, SCHEMA)


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digest_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
