"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi.

At each position the automaton's state and its output links name all pieces that end there; each relaxes the
best score of its end. Characters that no piece covers are spelled in the model's byte pieces. Pieces never
run from a character into a following space mark (checked when the model is read), so a text is segmented
word by word, and frequent words are remembered.

The vocabulary file is public and is only read: on the driver, from ``path``, and handed to the tasks.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.llm.textblocks import slices

PATH = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Words remembered by a task's process, and their longest length.
REMEMBER, LONGEST = 200_000, 48
_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


@dataclass
class Pieces:
    """The normal pieces with their ids and scores, and the ids of the 256 byte pieces."""

    pieces: list[tuple[str, int, float]]
    byte_ids: list[int]
    _automaton: object = field(default=None, repr=False)
    _known: dict = field(default_factory=dict, repr=False)
    _spelled: list = field(default=None, repr=False)

    @staticmethod
    def load(path: str = PATH) -> Pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        byte_ids, normal = [0] * 256, []
        for i in range(model.get_piece_size()):
            if model.is_byte(i):
                byte_ids[int(model.id_to_piece(i)[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                normal.append((model.id_to_piece(i), i, model.get_score(i)))
        return Pieces(normal, byte_ids)

    def __post_init__(self) -> None:
        self.unknown = min((s for *_, s in self.pieces), default=0.0) - 10.0
        self.by_words = not any(re.search(f"[^{MARK}]{MARK}", p) for p, *_ in self.pieces)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_automaton": None, "_known": {}, "_spelled": None}

    @property
    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            self._automaton = ahocorasick.Automaton()
            for piece, i, score in self.pieces:
                self._automaton.add_word(piece, (len(piece), i, score))
            self._automaton.make_automaton()
        return self._automaton

    def viterbi(self, text: str) -> list[int]:
        """Ids of the segmentation of largest total score; of equal ones, that with the longer last piece."""
        n = len(text)
        best = [0.0] + [float("-inf")] * n
        back = [(0, -1)] * (n + 1)
        done, single = 0, False

        def close(upto: int) -> None:
            """Ends before ``upto`` have seen all their pieces: a character without one of its own may be unknown."""
            nonlocal done, single
            while done < upto:
                done += 1
                if not single and (score := best[done - 1] + self.unknown) > best[done]:
                    best[done], back[done] = score, (done - 1, -1)
                single = False

        for last, (length, i, score) in self.automaton.iter(text):
            end = last + 1
            if end > done + 1:
                close(end - 1)
            single = single or length == 1
            if (total := best[end - length] + score) > best[end]:
                best[end], back[end] = total, (end - length, i)
        close(n)
        out: list[int] = []
        end = n
        while end:
            start, i = back[end]
            if i >= 0:
                out.append(i)
            else:
                out.extend(self.byte_ids[b] for b in reversed(text[start:end].encode("utf-8", "surrogatepass")))
            end = start
        return out[::-1]

    def _marked(self, text: str) -> list[int]:
        if not self.by_words:
            return self.viterbi(text)
        known, out = self._known, []
        for word in _WORD.findall(text):
            ids = known.get(word)
            if ids is None:
                ids = self.viterbi(word)
                if len(word) <= LONGEST:
                    if len(known) >= REMEMBER:
                        known.clear()
                    known[word] = ids
            out += ids
        return out

    def encode(self, text: str) -> list[int]:
        """Ids of a text; one space mark goes before it. A space mark in the text itself is spelled in bytes."""
        if not text:
            return []
        own = [self.byte_ids[b] for b in MARK.encode()]
        out: list[int] = []
        for k, part in enumerate((" " + text).split(MARK)):
            if k:
                out += own
            out += self._marked(part.replace(" ", MARK))
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids of :meth:`encode`; ids without a text of their own (controls) are passed over."""
        if self._spelled is None:
            top = max([*self.byte_ids, *(i for _, i, _ in self.pieces)], default=0) + 1
            self._spelled = [b""] * top
            for piece, i, _ in self.pieces:
                self._spelled[i] = piece.replace(MARK, " ").encode()
            for b, i in enumerate(self.byte_ids):
                self._spelled[i] = bytes([b])
        spelled = self._spelled
        return b"".join([spelled[i] for i in ids]).decode("utf-8", "replace").removeprefix(" ")


def encode(docs: DataFrame, pieces: Pieces, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_byte_tokens, ids_crc32 (of the ids as little-endian 32-bit numbers), round_trip, ids of every row.

    round_trip: decoding the ids gives the text again. Null counts as the empty text, which has no ids.
    Repeated rows are each encoded; other columns are not looked at; an empty table gives an empty result.
    """
    held = docs.sparkSession.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = held.value
        in_bytes = np.zeros(max([*p.byte_ids, *(i for _, i, _ in p.pieces)], default=0) + 1, bool)
        in_bytes[p.byte_ids] = True
        for batch in batches:
            for part in slices(batch, "text"):
                texts = [t or "" for t in part.column("text").to_pylist()]
                ids = [p.encode(t) for t in texts]
                same = [p.decode(i) == t for i, t in zip(ids, texts, strict=True)]
                arrays = [np.array(i, np.int32) for i in ids]
                ends = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
                flat = np.concatenate([*arrays, np.zeros(0, np.int32)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(np.diff(ends).astype(np.int64)),
                        pa.array([int(in_bytes[a].sum()) for a in arrays], pa.int64()),
                        pa.array([zlib.crc32(a.astype("<i4").tobytes()) for a in arrays], pa.int64()),
                        pa.array(same, pa.bool_()),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
                    ],
                    names=["doc_id", "n_tokens", "n_byte_tokens", "ids_crc32", "round_trip", "ids"],
                )

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, n_byte_tokens long, ids_crc32 long, round_trip boolean, ids array<int>")


def decode(tokens: DataFrame, pieces: Pieces, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """doc_id, text of every row of ids; null ids give a null text."""
    held = tokens.sparkSession.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if i is None else held.value.decode(i) for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return tokens.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(ids).alias("ids")).mapInArrow(run, "doc_id long, text string")
