"""Context-tree weighting written down from its definition, for a few texts."""

import collections
import functools
import math


def grams(text, depth):
    """(context, byte) at each byte of a text and at its end, a zero; zeros stand before the text."""
    data = bytes(depth) + (text or "").encode() + b"\0"
    return [(data[i - depth : i], data[i]) for i in range(depth, len(data))]


def decisions(byte):
    """The eight decision nodes of a byte, each a prefix of its bits, and the bit decided there."""
    bits = f"{byte:08b}"
    return [(bits[:i], int(bits[i])) for i in range(8)]


class ContextTree:
    """For every decision node a tree of contexts up to `depth` bytes, with its Krichevsky-Trofimov estimates."""

    def __init__(self, texts, depth):
        self.depth = depth
        self.counts = collections.defaultdict(lambda: [0, 0])
        self.longer = collections.defaultdict(set)
        for (context, byte), n in collections.Counter(g for t in texts for g in grams(t, depth)).items():
            for node, bit in decisions(byte):
                for d in range(depth + 1):
                    c = context[depth - d :]
                    self.counts[node, c][bit] += n
                    if d:
                        self.longer[node, c[1:]].add(c)
        self.total = functools.cache(self._total)

    def own(self, node, c):
        """Natural log of the estimate's probability of all bits seen at a context."""
        a, b = self.counts[node, c] if (node, c) in self.counts else (0, 0)
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def below(self, node, c):
        return sum(self.total(node, longer) for longer in sorted(self.longer[node, c])) if (node, c) in self.longer else 0.0

    def _total(self, node, c):
        """Natural log of the weighted probability: half the estimate, half the product over the longer contexts."""
        own = self.own(node, c)
        if len(c) == self.depth:
            return own
        below = self.below(node, c)
        top = max(own, below)
        return top + math.log(math.exp(own - top) + math.exp(below - top)) - math.log(2)

    def one(self, node, context):
        """Probability of a one: the estimates on the path, each weighted by the posterior that its context is a leaf."""
        p, open_ = 0.0, 1.0
        for d in range(self.depth + 1):
            c = context[self.depth - d :]
            a, b = self.counts[node, c] if (node, c) in self.counts else (0, 0)
            stop = 1.0 if d == self.depth else math.exp(self.own(node, c) - math.log(2) - self.total(node, c))
            p += open_ * stop * (b + 0.5) / (a + b + 1)
            open_ *= 1 - stop
        return p

    def log10(self, context, byte):
        return sum(math.log10(self.one(node, context) if bit else 1 - self.one(node, context)) for node, bit in decisions(byte))

    def score(self, text):
        return sum(n * self.log10(*g) for g, n in collections.Counter(grams(text, self.depth)).items())
