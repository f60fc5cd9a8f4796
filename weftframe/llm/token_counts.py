"""Token counts under a unigram tokenizer, by dynamic programming over a trie of pre-tokens.

A text's pre-tokens are its white-space separated words, each with the word mark before it. The distinct pre-tokens a task meets are inserted in a
trie; each node's best score - the best sum of piece scores over all ways to cut the prefix it stands for - is computed once for all pre-tokens that
share the prefix, and the node where a pre-token ends stores its token count. Counting a text is then one look-up a word. Nothing is shuffled; a task's trie
is emptied beyond `most_words` pre-tokens, which changes no result.

The public vocabularies are BPE and hold ranks, not probabilities: a piece's score is that of Zipf's law, -log(rank + 2). A character
that no piece covers costs one token a byte. Of equal scores the cut with fewer tokens counts.

Defined results: a null, empty or blank text has 0 words and 0 tokens; a null doc_id is passed on; repeated rows are counted each;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text

MARK = "▁"
UNSEEN = -30.0
SLICE = 4 << 20  # bytes of text whose new words are walked together


def load_pieces(path: str) -> dict[str, float]:
    """Scores of the pieces of a SentencePiece model, by rank; control and byte pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i) or model.is_unused(i))]
    return {p: -log(rank + 2) for rank, p in enumerate(plain)}


class Trie:
    """Distinct pre-tokens. A node stands for a prefix and holds the best score over all cuts of it and the number of tokens of that cut; each is computed once,
    when the first pre-token with that prefix comes. counts holds those of the nodes where pre-tokens end.
    """

    def __init__(self, pieces: dict[str, float]):
        self.pieces = pieces
        self.tails = {p[i:] for p in pieces for i in range(len(p))}
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}  # by node and character
        self.score, self.tokens = [0.0], [0]
        self.counts: dict[str, int] = {}

    def insert(self, words: Iterable[str]) -> None:
        pieces, tails, child, score, tokens = self.pieces, self.tails, self.child, self.score, self.tokens
        path, last = [0], ""
        for word in sorted(words):  # so that a path begins where the last one is left
            full = MARK + word
            shared = 0
            for a, b in zip(last, full, strict=False):
                if a != b:
                    break
                shared += 1
            del path[shared + 1 :]
            for end in range(shared + 1, len(full) + 1):
                key = path[-1] << 21 | ord(full[end - 1])
                node = child.get(key)
                if node is None:
                    width = len(full[end - 1].encode("utf-8", "surrogatepass"))
                    best, count = score[path[-1]] + UNSEEN * width, tokens[path[-1]] + width
                    at = end - 1
                    while at >= 0 and (tail := full[at:end]) in tails:
                        own = pieces.get(tail)
                        if own is not None:
                            s, c = score[path[at]] + own, tokens[path[at]] + 1
                            if s > best or (s == best and c < count):
                                best, count = s, c
                        at -= 1
                    node = child[key] = len(score)
                    score.append(best)
                    tokens.append(count)
                path.append(node)
            self.counts[word] = tokens[path[-1]]
            last = full


def count_tokens(docs: DataFrame, pieces: dict[str, float], most_words: int = 300_000) -> DataFrame:
    """doc_id, n_words, n_tokens."""
    shared = docs.sparkSession.sparkContext.broadcast(pieces)  # as large as the vocabulary, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(shared.value)
        for batch in batches:
            for part, _, _ in _text.pieces(batch, most=SLICE):
                words = [(t or "").split() for t in part.column(1).to_pylist()]
                if len(trie.counts) > most_words:
                    trie.clear()
                trie.insert({w for ws in words for w in ws} - trie.counts.keys())
                get = trie.counts.__getitem__
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(ws) for ws in words], pa.int64()), pa.array([sum(map(get, ws)) for ws in words], pa.int64())], ["doc_id", "n_words", "n_tokens"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, n_words bigint, n_tokens bigint")


def op8_token_counts(spark, sf_dir: str, vocabulary: str = "/opt/tokenizers/piece_bpe_32k.model") -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), load_pieces(vocabulary))
