"""The definition of a join tree, followed to the letter: vertices in order, one at a time."""


def sweep(f, spec):
    """Labels by vertex, and the saddle above each node that has one."""
    up, node, label, parent = {}, {}, [0] * spec.n, {}

    def find(v):
        while up[v] != v:
            v = up[v]
        return v

    for v in sorted(range(spec.n), key=lambda i: (f[i], i)):
        x, y, z = v % spec.X, v // spec.X % spec.Y, v // (spec.X * spec.Y)
        near = [v + s * d for d, c, e in zip(spec.strides, (x, y, z), (spec.X, spec.Y, spec.Z)) for s in (-1, 1) if 0 <= c + s < e]
        roots = {find(u) for u in near if u in up}
        up[v] = v
        node[v] = node[next(iter(roots))] if len(roots) == 1 else v
        for r in roots:
            if len(roots) > 1:
                parent[node[r]] = v
            up[r] = v
        label[v] = node[v]
    return label, parent
