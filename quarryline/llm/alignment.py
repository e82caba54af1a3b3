"""Alignment of two tokenizers' tokens by a dangling-suffix transducer.

Both token sequences spell the same bytes. The transducer's state is what one side has spelled and the other has not: which
side leads, and its unmatched bytes. From a state it takes the next token of the side behind (of A when neither leads);
the transition is memoised by state and token. A group closes whenever nothing is unmatched; its last two tokens end
together, which links them.

Texts are cut before a space or line feed that follows a non-space: A's splitting pattern always cuts there, and no
entry of B has a space or line feed after another character (checked on its vocabulary; otherwise texts are not
cut), so both tokenize each chunk as they do the whole text and both sides end with the chunk. Each distinct chunk goes through the
tokenizers and the transducer once a worker (in bounded memory, which starts afresh when it is full); a text is its chunks in order.

Link counts: pairs of entries that can be linked end in the same bytes, one a suffix of the other, so their number is
bounded by the vocabularies (an entry has as many suffixes as bytes), not by the corpus: the table of counts is
broadcast, the links of documents stay where they are.

Null and empty texts, and texts that either tokenizer does not spell back, have no tokens. Very long texts without a cut
are one chunk. Repeated rows are aligned each on its own; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written
from .packing import _byte_symbols

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Chunks (and eight times as many links) and transitions that a worker remembers; beyond, the memory starts afresh.
CHUNKS, TRANSITIONS = 500_000, 1_000_000
_CUT = re.compile("(?<=\\S)(?=[ \n])")


class Transducer:
    """Groups of two token sequences that spell the same bytes; spell_a and spell_b give an entry's bytes."""

    def __init__(self, spell_a: list[bytes], spell_b: list[bytes]):
        self.spell = (spell_a, spell_b)
        self._clear()

    def _clear(self) -> None:
        self.states: dict[tuple[int, bytes], int] = {(0, b""): 0}
        self.residuals: list[tuple[int, bytes]] = [(0, b"")]
        self.behind: list[int] = [0]  # the side that a state takes its next token from
        self.moves: list[dict[int, int]] = [{}]
        self.known = 0

    def _move(self, state: int, token: int) -> int:
        """The state after the side behind has spelled this token, remembered; -1 if its bytes differ from those it has to match."""
        lead, rest = self.residuals[state]
        behind = self.behind[state]
        said = self.spell[behind][token]
        if rest.startswith(said):
            key = (lead, rest[len(said) :])
        elif said.startswith(rest):
            key = (behind, said[len(rest) :])
        else:
            return -1
        if not key[1]:
            key = (0, b"")
        if key not in self.states:
            self.states[key] = len(self.residuals)
            self.residuals.append(key)
            self.behind.append(1 - key[0])
            self.moves.append({})
        self.moves[state][token] = self.states[key]
        self.known += 1
        return self.states[key]

    def groups(self, a: list[int], b: list[int]) -> list[tuple[int, int]] | None:
        """Where the groups end in a and b, in order; None if the two do not spell the same bytes."""
        if self.known > TRANSITIONS:
            self._clear()
        out, moves, behind = [], self.moves, self.behind
        n_a, n_b = len(a), len(b)
        i = j = state = 0
        while True:
            if behind[state]:
                if j == n_b:
                    return None
                token = b[j]
                j += 1
            else:
                if i == n_a:
                    break
                token = a[i]
                i += 1
            after = moves[state].get(token)
            if after is None:
                after = self._move(state, token)
                if after < 0:
                    return None
            state = after
            if not state:
                out.append((i, j))
        return out if state == 0 and j == n_b else None


class Aligner:
    """Alignments of texts, chunk by chunk."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        symbols = {s: b for b, s in _byte_symbols().items()}
        spell_a = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            spell_a[i] = bytes(symbols[c] for c in token) if all(c in symbols for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        spell_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.spell_b = spell_b
        self.transducer = Transducer(spell_a, spell_b)
        self.spell_a = spell_a
        self.size_a = np.array([len(x) for x in spell_a], np.int64)
        self.cuts = not any(" " in p.replace("▁", " ").lstrip(" ") or "\n" in p for p in pieces)
        self.names = [str(i) for i in range(max(len(spell_a), len(spell_b)))]
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.texts: list[str] = []
        self.flat = np.zeros(1 << 16, np.int64)  # keys of the links of all known chunks
        self.facts = np.zeros((4, 1 << 14), np.int64)  # tokens of A, -1 if not spelled back; of B; links; start in flat
        self.used = 0

    def _a_ids(self, chunks: list[str]) -> list[list[int] | None]:
        """A's ids of chunks, None where they do not spell the chunk. Chunks go through A as one text, which it cuts where they meet."""
        closed = [k for k, c in enumerate(chunks) if not c[-1].isspace()]  # a space at an end would join the next chunk's
        if len(closed) == len(chunks):
            text = "".join(chunks)
            data = text.encode()
            ids = self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids
            if b"".join(map(self.spell_a.__getitem__, ids)) == data:
                size = [len(c) for c in chunks] if len(data) == len(text) else [len(c.encode()) for c in chunks]
                want, got = np.cumsum(size), np.cumsum(self.size_a[ids])
                at = np.minimum(np.searchsorted(got, want), len(got) - 1)
                if (got[at] == want).all():
                    end = (at + 1).tolist()
                    return [ids[x:y] for x, y in zip([0, *end[:-1]], end, strict=True)]
        elif closed:
            out: list[list[int] | None] = [None] * len(chunks)
            rest = [k for k, c in enumerate(chunks) if c[-1].isspace()]
            for some in (closed, rest):
                for k, ids in zip(some, self._a_ids([chunks[k] for k in some]), strict=True):
                    out[k] = ids
            return out
        every = [x.ids for x in self.a.encode_batch_fast(chunks, add_special_tokens=False)]
        return [ids if b"".join([self.spell_a[x] for x in ids]) == c.encode() else None for c, ids in zip(chunks, every, strict=True)]

    def _b_ids(self, chunks: list[str]) -> list[list[int]]:
        """B's ids of chunks. It puts a space before a text; a line feed, which joins nothing, shields a chunk from that."""
        if self.cuts:
            return [ids[2:] for ids in self.b.encode(["\n" + c for c in chunks], num_threads=1)]
        return self.b.encode([c[1:] for c in chunks], num_threads=1)

    def _learn(self, chunks: list[str]) -> None:
        """Align chunks that are not known yet."""
        names, rows, flat = self.names, [], []
        for a, b in zip(self._a_ids(chunks), self._b_ids(chunks), strict=True):
            ends = self.transducer.groups(a, b) if a is not None else None
            if ends is None:
                rows.append((-1, 0, 0, self.used + len(flat)))
                self.texts.append("")
                continue
            rows.append((len(a), len(b), len(ends), self.used + len(flat)))
            if len(ends) == 1:
                self.texts.append(f"{','.join([names[t] for t in a])}|{','.join([names[t] for t in b])}")
                flat.append(a[-1] << 32 | b[-1])
                continue
            i = j = 0
            text = []
            for x, y in ends:
                if x - i == 1 and y - j == 1:
                    text.append(f"{names[a[i]]}|{names[b[j]]}")
                else:
                    text.append(f"{','.join([names[t] for t in a[i:x]])}|{','.join([names[t] for t in b[j:y]])}")
                i, j = x, y
                flat.append(a[x - 1] << 32 | b[y - 1])
            self.texts.append(";".join(text))
        n, new = len(self.known), len(chunks)
        while n + new > self.facts.shape[1]:
            self.facts = np.concatenate([self.facts, np.zeros_like(self.facts)], 1)
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.facts[:, n : n + new] = np.array(rows, np.int64).T
        self.flat[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        self.known.update(zip(chunks, range(n, n + new), strict=True))

    def align(self, texts: list[str | None]) -> list[tuple]:
        """(n_a, n_b, n_groups, text of groups, keys, counts) of each text."""
        split = [(_CUT.split(" " + t) if self.cuts else [" " + t]) if t else [] for t in texts]
        if len(self.known) > CHUNKS or self.used > 8 * CHUNKS:
            self._clear()
        known = self.known
        new = [c for c in set().union(*split) if c not in known]
        for k in range(0, len(new), 4096):
            self._learn(new[k : k + 4096])
        out = []
        for chunks in split:
            at = np.fromiter(map(known.__getitem__, chunks), np.int64, len(chunks))
            n_a, n_b, size, start = self.facts[:, at]
            if not len(at) or n_a.min() < 0:
                out.append((0, 0, 0, "", [], []))
                continue
            ends = np.cumsum(size)
            keys = self.flat[np.repeat(start - ends + size, size) + np.arange(ends[-1])]
            each, times = np.unique(keys, return_counts=True)
            out.append((int(n_a.sum()), int(n_b.sum()), len(keys), ";".join(map(self.texts.__getitem__, at.tolist())), each, times))
        return out


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def alignments(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, with_groups: bool = False) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, groups_sha256, keys, times) of every document: keys hold its linked ids (A's in the upper 32 bits) once each.

    with_groups: a column `groups` with the groups as text, too.
    """

    def run(batches):
        a, b = a_path, b_path
        if a is None or b is None:
            import public_tokenizers

            a, b = a or public_tokenizers.path(A_FILE), b or public_tokenizers.path(B_FILE)
        aligner = _ALIGNERS.get((a, b)) or _ALIGNERS.setdefault((a, b), Aligner(a, b))
        for batch in batches:
            for k in range(0, len(batch), 200):
                part = batch.slice(k, 200)
                got = aligner.align(part["text"].to_pylist())
                sha = [hashlib.sha256(r[3].encode()).hexdigest() if r[3] else "" for r in got]
                columns = [part["doc_id"].cast(pa.int64()), *(pa.array([r[i] for r in got], pa.int64()) for i in range(3)), pa.array(sha, pa.string()), pa.array([r[4] for r in got], pa.list_(pa.int64())), pa.array([r[5] for r in got], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array([r[3] for r in got], pa.string())] if with_groups else []), names=names)

    schema = "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, keys array<long>, times array<long>" + (", groups string" if with_groups else "")
    names = [x.split()[0] for x in schema.split(", ")]
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def link_counts(aligned: DataFrame) -> DataFrame:
    """(key, count, best) of each linked pair of ids: its links in the corpus, and whether no pair of its B id has more."""
    counts = aligned.select(F.explode(F.arrays_zip("keys", "times")).alias("x")).groupBy(F.col("x.keys").alias("key")).agg(F.sum("x.times").alias("count"))
    of_b = Window.partitionBy(F.col("key").bitwiseAND(F.lit(0xFFFFFFFF)))
    return counts.withColumn("best", F.col("count") == F.max("count").over(of_b))


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every document."""
    aligned = written(alignments(docs, a_path, b_path).withColumn("row", F.monotonically_increasing_id()))
    counts = written(link_counts(aligned))
    links = aligned.select("row", F.explode(F.arrays_zip("keys", "times")).alias("x")).select("row", F.col("x.keys").alias("key"), F.col("x.times").alias("times"))
    sums = links.join(F.broadcast(counts), "key").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("count") * F.col("times")).alias("count_sum"), F.sum("times").alias("n_links"))
    none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return aligned.join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", none("n_links"), none("n_best"), none("count_sum"), "groups_sha256")
