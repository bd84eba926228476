"""Minimal acceptors of small vocabularies and their composition with a
one-edit transducer (plain Python, for one partition at a time)."""

from __future__ import annotations

from collections.abc import Iterator


class Acceptor:
    """The minimal deterministic acceptor of sorted distinct words: state 0 is
    the start, ``arcs`` has the arcs of each state, ``final`` whether it
    accepts. Built word by word; states are shared when a word's end is settled."""

    def __init__(self, words: list[str]):
        self.arcs: list[dict[str, int]] = [{}]
        self.final = [False]
        known: dict[tuple, int] = {}
        free: list[int] = []
        way = [0]                       # states of the word before
        before = ""
        for word in [*words, None]:
            same = 0
            if word is not None:
                while same < min(len(word), len(before)) and word[same] == before[same]:
                    same += 1
            while len(way) > same + 1:  # these states change no more
                state = way.pop()
                look = (self.final[state], tuple(self.arcs[state].items()))
                found = known.setdefault(look, state)
                if found != state:
                    self.arcs[way[-1]][before[len(way) - 1]] = found
                    free.append(state)
            if word is None:
                break
            for c in word[same:]:
                if free:
                    state = free.pop()
                    self.arcs[state], self.final[state] = {}, False
                else:
                    state = len(self.arcs)
                    self.arcs.append({})
                    self.final.append(False)
                self.arcs[way[-1]][c] = state
                way.append(state)
            self.final[way[-1]] = True
            before = word


def one_edit_pairs(acceptor: Acceptor, after: str = "") -> Iterator[tuple[str, str]]:
    """Pairs (u, v) that the composition acceptor - one edit - acceptor accepts,
    each once: u < v of equal length, one symbol replaced, or v with one symbol
    more than u. Of the places where the same symbol can be put in, the last
    one counts; ``after`` is what follows all words, so a place that would move
    into it does not count here.

    Before the edit both sides are in one state, which a walk over the acceptor
    visits with each word's beginning. After it they read the same symbols from
    two states; which ends two states have in common is kept for each pair."""
    arcs, final = acceptor.arcs, acceptor.final
    common: dict[tuple[int, int], list[str]] = {}

    def ends(p: int, q: int) -> list[str]:
        """Words that lead from both p and q to acceptance."""
        todo = [(p, q)]
        while todo:
            at = todo[-1]
            if at in common:
                todo.pop()
                continue
            a, b = at
            shared = [(c, (s, arcs[b][c])) for c, s in arcs[a].items() if c in arcs[b]]
            open_ = [pair for _, pair in shared if pair not in common]
            if open_:
                todo += open_
                continue
            common[at] = [""] * (final[a] and final[b]) + [c + x for c, pair in shared for x in common[pair]]
            todo.pop()
        return common[p, q]

    walk = [(0, "")]
    while walk:
        state, begin = walk.pop()
        out = list(arcs[state].items())
        for k, (a, p) in enumerate(out):
            for x in ends(state, p):                    # a put in
                if (x or after)[:1] != a:
                    yield begin + x, begin + a + x
            for b, q in out[k + 1:]:                    # a replaced by b
                for x in ends(p, q):
                    yield (begin + a + x, begin + b + x) if a < b else (begin + b + x, begin + a + x)
            walk.append((p, begin + a))
