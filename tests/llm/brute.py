"""Plain versions that several tests compare with."""


def brute_near_copies(rows):
    """Smallest id of each row's component, links being Jaccard similarities of 0.8 or more."""
    sets = {}
    for i, text in rows:
        words = (text or "").encode().lower().split()
        sets[i] = {b" ".join(words[j : j + 5]) for j in range(max(1, len(words) - 4))} if words else set()
    roots = {i: i for i in sets}

    def find(x):
        while roots[x] != x:
            x = roots[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                a_root, b_root = sorted((find(a), find(b)))
                roots[b_root] = a_root
    return {i: find(i) for i in sets}
