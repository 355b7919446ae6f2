"""Unigram token counts by dynamic programming over a trie of pre-tokens.

A pre-token is a run of white space's complement, with one word mark before it. Distinct pre-tokens
go into a trie; the forward score of a node is the best score of its path over all segmentations
into vocabulary pieces, so words share the work of their common prefix. Where a word ends its token
count is stored, and each later sight of the word is one look-up. The trie is kept by a worker
between batches and begun anew at `nodes` nodes; a word of more than `LONG` characters is scored
beside it, with the scores of the last few places only. So a worker's memory is bounded.

Scores: pieces score the logarithm of their share under Zipf's law of their rank in the vocabulary,
since the public vocabularies hold no unigram probabilities. A character that no piece covers costs
10 more than the lowest score and counts as its UTF-8 bytes where the vocabulary has byte pieces,
else as one token. Of equally good segmentations the one whose last piece is longest is taken, at
every node.

Nulls: a null or blank text has no tokens. Repeated rows, null ids and extra columns pass through; a
column with the name of a result (n_pretokens, n_tokens) gets a _ behind. A very long text is one
worker's work, at some hundred bytes of memory a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame

from . import common as C

MARK = "▁"
LONG = 200


def zipf_pieces(model_file: str) -> tuple[dict[str, float], bool]:
    """(scores of the normal pieces, whether bytes are pieces) of a sentencepiece vocabulary."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    n = sp.get_piece_size()
    normal = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    norm = log(sum(1 / (r + 2) for r in range(len(normal))))
    return {sp.id_to_piece(i): -log(r + 2) - norm for r, i in enumerate(normal)}, any(sp.is_byte(i) for i in range(n))


class Trie:
    """Nodes by number, in flat tables: a child by its parent and character, the best score and token count of a node's path."""

    def __init__(self, scores: dict[str, float], bytes_: bool, nodes: int = 500_000) -> None:
        self.scores, self.bytes, self.limit = scores, bytes_, nodes
        self.longest = max(map(len, scores), default=1)
        self.unknown = min(scores.values(), default=0.0) - 10
        # every end of a piece, with its score if it is one itself: what is none needn't be made longer
        self.ends = dict.fromkeys(p[i:] for p in scores for i in range(1, len(p))) | scores
        self.begin()

    def begin(self) -> None:
        self.child: dict[int, int] = {}
        self.best, self.tokens, self.counts = [0.0], [0], {}

    @property
    def size(self) -> int:
        return len(self.child)

    def count(self, word: str) -> int:
        found = self.counts.get(word)
        if found is not None:
            return found
        if len(word) > LONG:
            return self.along(word)
        if self.size >= self.limit:
            self.begin()
        child, best, tokens, ends = self.child, self.best, self.tokens, self.ends
        node, path = 0, [0]
        for end, c in enumerate(word, 1):
            edge = node << 21 | ord(c)
            at = child.get(edge)
            if at is None:
                top, n = None, 0
                for start in range(end - 1, -1, -1):
                    s = ends.get(word[start:end], False)
                    if s is False:
                        break
                    if s is not None and (top is None or best[path[start]] + s >= top):
                        top, n = best[path[start]] + s, tokens[path[start]] + 1
                if c not in self.scores and (top is None or best[node] + self.unknown > top):
                    top, n = best[node] + self.unknown, tokens[node] + (len(c.encode("utf-8", "replace")) if self.bytes else 1)
                at = child[edge] = len(best)
                best.append(top)
                tokens.append(n)
            path.append(at)
            node = at
        self.counts[word] = tokens[node]
        return tokens[node]

    def along(self, word: str) -> int:
        """What count() gives, without the trie: only the scores from which a piece can still begin are held."""
        path = [(0.0, 0)]
        for end, c in enumerate(word, 1):
            best, tokens = None, 0
            for back in range(len(path), 0, -1):
                s = self.scores.get(word[end - back : end])
                if s is not None and (best is None or path[-back][0] + s > best):
                    best, tokens = path[-back][0] + s, path[-back][1] + 1
            if c not in self.scores and (best is None or path[-1][0] + self.unknown > best):
                best, tokens = path[-1][0] + self.unknown, path[-1][1] + (len(c.encode("utf-8", "replace")) if self.bytes else 1)
            path = [*path[max(0, len(path) - self.longest + 1) :], (best, tokens)]
        return path[-1][1]


_TRIES: dict = {}


def token_counts(docs: DataFrame, model_file: str, nodes: int = 500_000) -> DataFrame:
    """docs with all its columns and n_pretokens, n_tokens."""
    spark = docs.sparkSession
    C.prepare(spark)
    held = spark.sparkContext.broadcast(zipf_pieces(model_file))
    at, key, added = docs.columns.index("text"), (model_file, nodes), ("n_pretokens", "n_tokens")
    docs = docs.toDF(*C.kept_names(docs.columns, added))
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _TRIES:
            _TRIES.clear()
            _TRIES[key] = Trie(*held.value, nodes)
        trie = _TRIES[key]
        for batch in batches:
            words, tokens = [], []
            for text in batch.column(at):
                own = (text.as_py() or "").split()
                known, total = trie.counts, 0
                for w in own:
                    n = known.get(MARK + w)
                    if n is None:
                        n = trie.count(MARK + w)
                        known = trie.counts
                    total += n
                words.append(len(own))
                tokens.append(total)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=[*names, *added])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{kinds}, n_pretokens long, n_tokens long")
