"""Path-dependent SHAP of one row and tree by recursion (independent of the library's leaf form)."""


def tree_shap_row(x, tree, phi, scale):
    """Add ``scale`` x the tree's SHAP values for row ``x`` into ``phi`` (Algorithm 2)."""
    feat, thr, left, right, value, cover, root = tree

    def extend(path, pz, po, pi):
        # path: list of [feature, zero_fraction, one_fraction, weight]
        depth = len(path)
        path = [list(e) for e in path] + [[pi, pz, po, 1.0 if depth == 0 else 0.0]]
        for i in range(depth - 1, -1, -1):
            path[i + 1][3] += po * path[i][3] * (i + 1) / (depth + 1)
            path[i][3] = pz * path[i][3] * (depth - i) / (depth + 1)
        return path

    def unwind(path, k):
        depth = len(path) - 1
        po, pz = path[k][2], path[k][1]
        nxt = path[depth][3]
        path = [list(e) for e in path]
        for i in range(depth - 1, -1, -1):
            if po != 0:
                tmp = path[i][3]
                path[i][3] = nxt * (depth + 1) / ((i + 1) * po)
                nxt = tmp - path[i][3] * pz * (depth - i) / (depth + 1)
            else:
                path[i][3] = path[i][3] * (depth + 1) / (pz * (depth - i))
        for i in range(k, depth):
            path[i][0], path[i][1], path[i][2] = path[i + 1][0], path[i + 1][1], path[i + 1][2]
        return path[:depth]

    def unwound_sum(path, k):
        depth = len(path) - 1
        po, pz = path[k][2], path[k][1]
        nxt = path[depth][3]
        total = 0.0
        for i in range(depth - 1, -1, -1):
            if po != 0:
                tmp = nxt * (depth + 1) / ((i + 1) * po)
                total += tmp
                nxt = path[i][3] - tmp * pz * (depth - i) / (depth + 1)
            else:
                total += (path[i][3] / pz) / ((depth - i) / (depth + 1))
        return total

    def recurse(j, path, pz, po, pi):
        path = extend(path, pz, po, pi)
        if left[j] < 0:
            for i in range(1, len(path)):
                w = unwound_sum(path, i)
                phi[path[i][0]] += scale * w * (path[i][2] - path[i][1]) * value[j]
            return
        d = feat[j]
        hot, cold = (left[j], right[j]) if x[d] <= thr[j] else (right[j], left[j])
        iz, io = 1.0, 1.0
        for k in range(1, len(path)):
            if path[k][0] == d:
                iz, io = path[k][1], path[k][2]
                path = unwind(path, k)
                break
        recurse(hot, path, iz * cover[hot] / cover[j], io, d)
        recurse(cold, path, iz * cover[cold] / cover[j], 0.0, d)

    recurse(root, [], 1.0, 1.0, -1)
