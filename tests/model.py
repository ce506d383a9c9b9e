"""Plain-Python models of the word-set operators, for small inputs, and seeded generators."""

import random

TURN = str.maketrans("ACGT", "TGCA")


def rc(s):
    return s[::-1].translate(TURN)


def canonical(s):
    return min(s, rc(s))


def words(s, k, both=True):
    return {canonical(s[i : i + k]) if both else s[i : i + k] for i in range(len(s) - k + 1)}


def random_words(seed, n, k, both=True):
    r = random.Random(seed)
    return sorted({canonical(w) if both else w for w in ("".join(r.choice("ACGT") for _ in range(k)) for _ in range(n))})


def next_of(s, held, both):
    own = canonical(s) if both else s
    out = []
    for b in "ACGT":
        t = s[1:] + b
        c = canonical(t) if both else t
        if c in held and c != own:
            out.append(t)
    return out


def before(s, held, both):
    own = canonical(s) if both else s
    return [t for t in (b + s[:-1] for b in "ACGT") if (canonical(t) if both else t) in held and (canonical(t) if both else t) != own]


def unitigs(kmers, both=True):
    """Canonical forms (or strings) of all maximal non-branching paths; a ring gives its set of words."""
    held, seen, out, rings = set(kmers), set(), [], []

    def on(s):
        n = next_of(s, held, both)
        return n[0] if len(n) == 1 and len(before(n[0], held, both)) == 1 else None

    def back(s):
        p = before(s, held, both)
        return p[0] if len(p) == 1 and len(next_of(p[0], held, both)) == 1 else None

    for w in kmers:
        if w in seen:
            continue
        head, ring = w, False
        while (p := back(head)) is not None:
            head = p
            if head == w:
                ring = True
                break
        path, s = [head], head
        while (n := on(s)) is not None and n != head:
            path.append(n)
            s = n
        members = {canonical(x) if both else x for x in path}
        seen |= members
        if ring:
            rings.append(frozenset(members))
        else:
            text = path[0] + "".join(x[-1] for x in path[1:])
            out.append(canonical(text) if both else text)
    return sorted(out), sorted(map(sorted, rings))
