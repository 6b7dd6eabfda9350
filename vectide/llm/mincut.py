"""Two-label minimum cuts of small graphs (Dinic's algorithm)."""

from __future__ import annotations

from collections import deque

EPS = 1e-9


def min_cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels that minimise the summed cost: a node labelled False pays its score
    if positive, one labelled True pays minus its score if negative, and an edge
    between different labels pays its weight (>= 0). Ties go to False.

    Nodes whose score outweighs all their edges have their label at once, as no
    neighbour can change it; only the rest goes through the flow network.
    """
    n = len(scores)
    pull = list(scores)
    around: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    weight = [0.0] * n
    for a, b, w in edges:
        if a != b and w > 0:
            around[a].append((b, w))
            around[b].append((a, w))
            weight[a] += w
            weight[b] += w
    label: list[bool | None] = [None] * n
    todo = [i for i in range(n) if abs(pull[i]) > weight[i]]
    while todo:
        i = todo.pop()
        if label[i] is not None:
            continue
        label[i] = pull[i] > 0
        for j, w in around[i]:
            if label[j] is None:
                pull[j] += w if label[i] else -w
                weight[j] -= w
                if abs(pull[j]) > weight[j] + EPS:
                    todo.append(j)
    free = [i for i in range(n) if label[i] is None]
    if free:
        place = {i: k for k, i in enumerate(free)}
        inner = [(place[i], place[j], w) for i in free for j, w in around[i] if i < j and j in place]
        for i, side in zip(free, _flow_side([pull[i] for i in free], inner)):
            label[i] = side
    return [bool(x) for x in label]


def _flow_side(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Nodes on the source side of a maximum flow."""
    n = len(scores)
    source, sink = n, n + 1
    to: list[int] = []
    left: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def link(a: int, b: int, there: float, back: float) -> None:
        out[a].append(len(to))
        to.append(b)
        left.append(there)
        out[b].append(len(to))
        to.append(a)
        left.append(back)

    for i, s in enumerate(scores):
        if s > 0:
            link(source, i, s, 0.0)
        elif s < 0:
            link(i, sink, -s, 0.0)
    for a, b, w in edges:
        link(a, b, w, w)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            u = queue.popleft()
            for e in out[u]:
                if left[e] > EPS and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        at = [0] * (n + 2)
        path: list[int] = []
        u = source
        while True:
            if u == sink:
                flow = min(left[e] for e in path)
                for e in path:
                    left[e] -= flow
                    left[e ^ 1] += flow
                k = next(k for k, e in enumerate(path) if left[e] <= EPS)
                u = to[path[k] ^ 1]
                del path[k:]
            elif at[u] < len(out[u]):
                e = out[u][at[u]]
                if left[e] > EPS and level[to[e]] == level[u] + 1:
                    path.append(e)
                    u = to[e]
                else:
                    at[u] += 1
            elif path:
                u = to[path.pop() ^ 1]
                at[u] += 1
            else:
                break
