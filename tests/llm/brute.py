"""Plain helpers of the brute-force versions."""


def classes(nodes, links):
    """Smallest reachable node of each node."""
    root = {n: n for n in nodes}

    def top(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        p, q = top(a), top(b)
        root[max(p, q)] = min(p, q)
    return {n: top(n) for n in root}
