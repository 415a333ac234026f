"""Both lattice scores of the query against sums over all segmentations."""

import collections
import math
import zlib

import numpy as np

from mlqa.llm import catalog, lm_lattice
from mlqa.llm.lattice import MARK

from llm_tables import docs_of  # noqa: F401

TEXTS = ["the cat", "a cat and the dog", "the dog", "the bird 日", "Été", None, "", "the THE cat", "x", "cat cat", "un é", "dog", "the cat"]


def segmentations(word, pieces):
    """Every way to write the word as pieces, or as bytes where a character is no piece itself."""
    if not word:
        yield []
        return
    for n in range(1, len(word) + 1):
        if word[:n] in pieces:
            for rest in segmentations(word[n:], pieces):
                yield [word[:n], *rest]
    if word[0] not in pieces:
        for rest in segmentations(word[1:], pieces):
            yield [tuple(word[0].encode()), *rest]


def weigh(parts, piece, byte):
    return sum(piece[p] if isinstance(p, str) else sum(byte[b] for b in p) for p in parts)


def test_scores_by_enumeration(docs_of):
    path = catalog.vocabulary(catalog.PIECES)
    got = {r.doc_id: r for r in lm_lattice.score_documents(docs_of(TEXTS), path).collect()}
    vocabulary = lm_lattice.read_vocabulary(path)
    index = {p: i for i, p in enumerate(vocabulary["pieces"])}
    low = [(t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).split(" ") for t in TEXTS]
    low = [[w for w in ws if w] for ws in low]
    train = [i for i in range(len(TEXTS)) if zlib.crc32(str(i).encode()) % 7 != 2]
    counts = collections.Counter(w for i in train for w in low[i])
    ways = {w: list(segmentations(MARK + w, index)) for ws in low for w in ws}

    def log_p(word, weights):
        piece = {p: weights.pieces[index[p]] for way in ways[word] for p in way if isinstance(p, str)}
        return np.logaddexp.reduce([weigh(way, piece, weights.byte) for way in ways[word]])

    plain = weights = lm_lattice.Weights(vocabulary)
    for _ in range(lm_lattice.ROUNDS):
        use, use_byte = np.zeros(len(index)), np.zeros(256)
        for w in counts:
            z, piece = log_p(w, weights), {p: weights.pieces[index[p]] for way in ways[w] for p in way if isinstance(p, str)}
            for way in ways[w]:
                share = math.exp(weigh(way, piece, weights.byte) - z)
                for p in way:
                    if isinstance(p, str):
                        use[index[p]] += share
                    else:
                        for b in p:
                            use_byte[b] += share
        weights = lm_lattice.Weights(vocabulary, use, use_byte)
    n, v = sum(counts.values()), len(counts)
    seen = collections.Counter(counts.values())
    discount = seen[1] / (seen[1] + 2 * seen[2])
    end = (len(train) + 0.5) / (n + len(train) + 1)
    for i, ws in enumerate(low):
        own = sum(log_p(w, plain) for w in ws) + len(ws) * math.log(1 - end) + math.log(end)
        mixed = sum(math.log((max(counts[w] - discount, 0) + (discount * v + 1) * math.exp(log_p(w, weights))) / (n + 1)) for w in ws)
        assert math.isclose(got[i].lattice_score, own / math.log(10), rel_tol=1e-9)
        assert math.isclose(got[i].score, (mixed + len(ws) * math.log(1 - end) + math.log(end)) / math.log(10), rel_tol=1e-9)
