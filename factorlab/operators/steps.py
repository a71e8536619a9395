"""One iteration of each multiplicative solver, in matrix operators only.

xp gives the few operations that aren't operators: functions.dense.Dense for arrays, functions.sqlmath.Program for SQL.
Where a fit depends on the samples only through products (S_YA = YA', S_AA = AA', ..), those are the arguments, so that one
distributed pass serves all iterations.
"""

from __future__ import annotations

from ..functions.dense import offdiag, path_neighbours

EPS, TINY = 1e-10, 1e-16


def normalized(xp, x, how: str = "colSums"):
    if how == "colSums":
        return x / xp.sum(x, 0)
    if how == "colSqSums":
        return x / xp.power(xp.sum(x * x, 0), 0.5)
    if how == "totalSum":
        return x / xp.sum(x)
    return x


def ortho(xp, x):
    """Gradient of half the squared off-diagonal of X'X."""
    return x @ ((x.T @ x) * offdiag(xp, x.shape[1]))


def _basis(xp, x, up, down, l2_ortho, l2_smooth, how, eps=EPS):
    """The multiplicative X-step from numerator and denominator, with its penalties."""
    if how == "fixed":
        return x
    if l2_ortho:
        down = down + l2_ortho * ortho(xp, x)
    if l2_smooth and x.shape[0] >= 2:
        near = path_neighbours(x.shape[0])
        up = up + l2_smooth * (xp.const(near) @ x)
        down = down + l2_smooth * (xp.const(near.sum(axis=1, keepdims=True)) * x)
    return normalized(xp, x * (up / (down + eps)), how)


def core_eu(xp, x, c, s_ya, s_aa, l1=0.0, l2_ortho=0.0, l2_smooth=0.0, how="colSums"):
    """Squared error, covariates or none (then c = B, s_ya = Y and s_aa = I). The fit at the loop's top serves both steps."""
    m = c @ s_aa
    new = _basis(xp, x, s_ya @ c.T, x @ (m @ c.T), l2_ortho, l2_smooth, how)
    down = (new.T @ x) @ m
    if l1:
        down = down + l1 / 2
    return new, c * ((new.T @ s_ya) / (down + EPS))


def core_eu_value(xp, x, c, s_ya, s_aa, yy):
    return yy - 2 * xp.sum(x * (s_ya @ c.T)) + xp.sum((x.T @ x) * ((c @ s_aa) @ c.T))


def core_free(xp, x, b, y, l1=0.0, l2_ortho=0.0, l2_smooth=0.0, how="colSums"):
    """Squared error without covariates: B has a column for each sample."""
    xb = x @ b
    new = _basis(xp, x, y @ b.T, xb @ b.T, l2_ortho, l2_smooth, how)
    down = new.T @ xb
    if l1:
        down = down + l1 / 2
    return new, b * ((new.T @ y) / (down + EPS))


def core_weighted(xp, x, c, y, w, a=None, l1=0.0, l2_ortho=0.0, l2_smooth=0.0, how="colSums"):
    """Squared error with weights, linear in w."""
    b = c if a is None else c @ a
    wy, wxb = w * y, w * (x @ b)
    new = _basis(xp, x, wy @ b.T, wxb @ b.T, l2_ortho, l2_smooth, how)
    up, down = new.T @ wy, new.T @ wxb
    if a is not None:
        up, down = up @ a.T, down @ a.T
    if l1:
        down = down + l1 / 2
    return new, c * (up / (down + EPS))


def core_kl(xp, x, c, y, a=None, w=None, l1=0.0, l2_ortho=0.0, l2_smooth=0.0, how="colSums"):
    """Kullback-Leibler loss; ratios are taken at the loop's top."""
    b = c if a is None else c @ a
    xb = x @ b
    ratio = y / (xb + EPS)
    ones = w if w is not None else xb * 0 + 1
    if w is not None:
        ratio = w * ratio
    new = _basis(xp, x, ratio @ b.T, ones @ b.T, l2_ortho, l2_smooth, how)
    up, down = new.T @ ratio, new.T @ ones
    if a is not None:
        up, down = up @ a.T, down @ a.T
    if l1:
        down = down + l1
    return new, c * (up / (down + EPS))


def reduced_rank(xp, x1, c, x2, s12, s22, l1=0.0, ortho1=0.0, ortho2=0.0):
    """Y1 ~ X1 C X2 Y2, all non-negative; columns of X1 and rows of X2 sum to 1, C takes the scale."""
    x2s, up = x2 @ s22, s12 @ x2.T
    down = x1 @ (c @ (x2s @ x2.T) @ c.T)
    if ortho1:
        down = down + ortho1 * ortho(xp, x1)
    x1 = x1 * ((up @ c.T) / (down + EPS))
    d = xp.sum(x1, 0)
    x1, c = x1 / d, c * d.T
    down = (x1.T @ x1) @ c @ (x2s @ x2.T)
    if l1:
        down = down + l1 / 2
    c = c * ((x1.T @ up) / (down + EPS))
    h = x1 @ c
    down = (h.T @ h) @ x2s
    if ortho2:
        down = down + ortho2 * ortho(xp, x2.T).T
    x2 = x2 * ((h.T @ s12) / (down + EPS))
    d = xp.sum(x2, 1)
    return x1, c * d.T, x2 / d


def _pulls(xp, y, hat, w, kl: bool):
    """What stands for Y above and for its fit below in a multiplicative step: both P x N, with weights (linear) and loss."""
    if kl:
        ratio = y / (hat + EPS)
        return (ratio, hat * 0 + 1) if w is None else (w * ratio, w)
    return (y, hat) if w is None else (w * y, w * hat)


def reduced_rank_cells(xp, x1, c, x2, y1, y2, w=None, kl=False, l1=0.0, ortho1=0.0, ortho2=0.0):
    """reduced_rank() with weights, missing cells (weight 0) or Kullback-Leibler loss, for which products don't suffice.

    Each factor is renewed from the fit that the ones before it have left.
    """
    f = c @ (x2 @ y2)
    up, down = _pulls(xp, y1, x1 @ f, w, kl)
    down = down @ f.T
    if ortho1:
        down = down + ortho1 * ortho(xp, x1)
    x1 = x1 * ((up @ f.T) / (down + EPS))
    d = xp.sum(x1, 0)
    x1, c = x1 / d, c * d.T
    g = x2 @ y2
    up, down = _pulls(xp, y1, x1 @ (c @ g), w, kl)
    down = (x1.T @ down) @ g.T
    if l1:
        down = down + (l1 if kl else l1 / 2)
    c = c * (((x1.T @ up) @ g.T) / (down + EPS))
    h = x1 @ c
    up, down = _pulls(xp, y1, h @ g, w, kl)
    down = (h.T @ down) @ y2.T
    if ortho2:
        down = down + ortho2 * ortho(xp, x2.T).T
    x2 = x2 * (((h.T @ up) @ y2.T) / (down + EPS))
    d = xp.sum(x2, 1)
    return x1, c * d.T, x2 / d


def signed(xp, x, cp, cn, g0, s_pos, s_neg, l2_c=0.0, l2_ortho=0.0, how="colSums", l2_smooth=0.0):
    """Y ~ X (C+ - C-) A with signed A and Y; g0 = YA', S = AA' split by sign."""
    g, p = x.T @ g0, x.T @ x
    gp, gn = xp.pos(g), xp.pos(-g)

    def share(a, b):  # what pulls a up while b is as it is
        return p @ a @ s_neg + p @ b @ s_pos + l2_c * b

    def held(a, b):
        return p @ a @ s_pos + p @ b @ s_neg + l2_c * a

    cp = cp * (gp + share(cp, cn)) / (gn + held(cp, cn) + TINY)
    cn = cn * (gn + share(cn, cp)) / (gp + held(cn, cp) + TINY)
    if how == "fixed":
        return x, cp, cn
    h = cp - cn
    yh, hh = g0 @ h.T, (h @ (s_pos - s_neg)) @ h.T
    up, down = xp.pos(yh) + x @ xp.pos(-hh), xp.pos(-yh) + x @ xp.pos(hh)
    if l2_ortho:
        down = down + l2_ortho * ortho(xp, x)
    if l2_smooth:
        near = path_neighbours(x.shape[0])
        up = up + l2_smooth * (xp.const(near) @ x)
        down = down + l2_smooth * (xp.const(near.sum(axis=1, keepdims=True)) * x)
    x = x * up / (down + TINY)
    if how == "none":
        return x, cp, cn
    d = {"colSums": lambda: xp.sum(x, 0), "colSqSums": lambda: xp.power(xp.sum(x * x, 0), 0.5), "totalSum": lambda: xp.sum(x, 0) * 0 + xp.sum(x)}[how]()
    return x / d, cp * d.T, cn * d.T


def signed_reduced_rank(xp, x1, cp, cn, x2, s12, s22, l2_c=0.0, ortho1=0.0, ortho2=0.0):
    """Y1 ~ X1 (C+ - C-) X2 Y2 with signed Y1; s12 = Y1 Y2', s22 = Y2 Y2'."""
    p, sx = x1.T @ x1, (x2 @ s22) @ x2.T
    g = (x1.T @ s12) @ x2.T
    gp, gn = xp.pos(g), xp.pos(-g)
    other = p @ cn @ sx
    cp = cp * (gp + other + l2_c * cn) / (gn + p @ cp @ sx + l2_c * cp + TINY)
    cn = cn * (gn + p @ cp @ sx + l2_c * cp) / (gp + other + l2_c * cn + TINY)
    y = s12 @ x2.T
    yp, yn = xp.pos(y), xp.pos(-y)
    same = (cp @ sx) @ cp.T + (cn @ sx) @ cn.T
    cross = (cp @ sx) @ cn.T + (cn @ sx) @ cp.T
    down = yn @ cp.T + yp @ cn.T + x1 @ same + TINY
    if ortho1:
        down = down + ortho1 * ortho(xp, x1)
    x1 = x1 * (yp @ cp.T + yn @ cn.T + x1 @ cross) / down
    d = xp.sum(x1, 0) + TINY
    x1, cp, cn = x1 / d, cp * d.T, cn * d.T
    a = x1.T @ s12
    ap, an, p = xp.pos(a), xp.pos(-a), x1.T @ x1
    same, cross = cp.T @ p @ cp + cn.T @ p @ cn, cp.T @ p @ cn + cn.T @ p @ cp
    down = cp.T @ an + cn.T @ ap + same @ x2 @ s22 + TINY
    if ortho2:
        down = down + ortho2 * ortho(xp, x2.T).T
    x2 = x2 * (cp.T @ ap + cn.T @ an + cross @ x2 @ s22) / down
    d = xp.sum(x2, 1) + TINY
    return x1, cp * d.T, cn * d.T, x2 / d


def signed_reduced_rank_cells(xp, x1, cp, cn, x2, y1, y2, w, l2_c=0.0, ortho1=0.0, ortho2=0.0):
    """signed_reduced_rank() with weights, linear in w."""
    f, wy = x2 @ y2, w * y1
    g = (x1.T @ wy) @ f.T
    gp, gn = xp.pos(g), xp.pos(-g)

    def held(c):
        return (x1.T @ (w * (x1 @ (c @ f)))) @ f.T

    other = held(cn)
    cp = cp * (gp + other + l2_c * cn) / (gn + held(cp) + l2_c * cp + TINY)
    own = held(cp)
    cn = cn * (gn + own + l2_c * cp) / (gp + other + l2_c * cn + TINY)
    mp, mn = cp @ f, cn @ f
    yp, yn, wp, wn = wy @ mp.T, wy @ mn.T, w * (x1 @ mp), w * (x1 @ mn)
    down = xp.pos(-yp) + xp.pos(yn) + wp @ mp.T + wn @ mn.T + TINY
    if ortho1:
        down = down + ortho1 * ortho(xp, x1)
    x1 = x1 * (xp.pos(yp) + xp.pos(-yn) + wp @ mn.T + wn @ mp.T) / down
    d = xp.sum(x1, 0) + TINY
    x1, cp, cn = x1 / d, cp * d.T, cn * d.T
    hp, hn = x1 @ cp, x1 @ cn
    yp, yn, wp, wn = (hp.T @ wy) @ y2.T, (hn.T @ wy) @ y2.T, w * (hp @ f), w * (hn @ f)
    down = xp.pos(-yp) + xp.pos(yn) + (hp.T @ wp) @ y2.T + (hn.T @ wn) @ y2.T + TINY
    if ortho2:
        down = down + ortho2 * ortho(xp, x2.T).T
    x2 = x2 * (xp.pos(yp) + xp.pos(-yn) + (hp.T @ wn) @ y2.T + (hn.T @ wp) @ y2.T) / down
    d = xp.sum(x2, 1) + TINY
    return x1, cp * d.T, cn * d.T, x2 / d


def _seen(x, c, w, p):
    """(W * X C X') X; without weights X C X'X, with p = X'X."""
    return x @ (c @ p) if w is None else (w * ((x @ c) @ x.T)) @ x


def network_tri(xp, x, c, y, l1=0.0, l2_ortho=0.0, how="colSums", w=None):
    """Y ~ X C X' for symmetric Y (and weights); norms move into both sides of C."""
    p, yx = x.T @ x, (y if w is None else w * y) @ x
    below = p @ c @ p if w is None else x.T @ _seen(x, c, w, p)
    c = c * ((x.T @ yx) / (below + (l1 / 2 + TINY)))
    t = c + c.T
    if how == "fixed":
        return x, c
    down = (x @ (c @ p @ t) if w is None else _seen(x, c, w, p) @ t) + TINY
    if l2_ortho:
        down = down + l2_ortho * ortho(xp, x)
    x = x * ((yx @ t) / down)
    if how == "none":
        return x, c
    d = xp.sum(x, 0) if how == "colSums" else xp.power(xp.sum(x * x, 0), 0.5)
    return x / d, c * (d.T @ d)


def network_bi(xp, x, y, l2_ortho=0.0, how="none", w=None):
    """Y ~ X X', damped by the cube root."""
    if how == "fixed":
        return x
    down = (x @ (x.T @ x) if w is None else (w * (x @ x.T)) @ x) + TINY
    if l2_ortho:
        down = down + l2_ortho * ortho(xp, x)
    yx = (y if w is None else w * y) @ x
    return normalized(xp, x * xp.power(yx / down, 1.0 / 3.0), how)


def network_signed(xp, x, cp, cn, y, l2_ortho=0.0, how="colSums", w=None):
    """Y ~ X (C+ - C-) X'."""
    p, yx = x.T @ x, (y if w is None else w * y) @ x
    held = lambda c: p @ c @ p if w is None else x.T @ _seen(x, c, w, p)
    g = x.T @ yx
    hn = held(cn)
    cp = cp * (g + hn) / (held(cp) + TINY)
    hp = held(cp)
    cn = cn * hp / (g + hn + TINY)
    if how == "fixed":
        return x, cp, cn
    tp, tn = cp + cp.T, cn + cn.T
    xp_p, xn_p = _seen(x, cp, w, p), _seen(x, cn, w, p)
    up = yx @ tp + xp_p @ tn + xn_p @ tp
    down = yx @ tn + xp_p @ tp + xn_p @ tn + TINY
    if l2_ortho:
        down = down + l2_ortho * ortho(xp, x)
    x = x * (up / down)
    if how == "none":
        return x, cp, cn
    d = xp.sum(x, 0) if how == "colSums" else xp.power(xp.sum(x * x, 0), 0.5)
    return x / d, cp * (d.T @ d), cn * (d.T @ d)


def feedback(xp, x, c1, c2, s11, s12, s22, l2_ortho=0.0, l1_1=0.0, l1_2=0.0):
    """Y1 ~ X (C1 Y1 + C2 Y2)."""
    cross = c1 @ s12 @ c2.T
    mm = c1 @ s11 @ c1.T + cross + cross.T + c2 @ s22 @ c2.T
    down = x @ mm + EPS
    if l2_ortho:
        down = down + l2_ortho * ortho(xp, x)
    x = x * ((s11 @ c1.T + s12 @ c2.T) / down)
    x = x / xp.sum(x, 0)
    return feedback_paths(xp, x, c1, c2, s11, s12, s22, l1_1, l1_2)


def feedback_paths(xp, x, c1, c2, s11, s12, s22, l1_1=0.0, l1_2=0.0):
    """The coefficients of feedback() for the basis as it is."""
    p = x.T @ x
    c1 = c1 * ((x.T @ s11) / (p @ (c1 @ s11 + c2 @ s12.T) + (l1_1 + EPS)))
    c2 = c2 * ((x.T @ s12) / (p @ (c1 @ s12 + c2 @ s22) + (l1_2 + EPS)))
    return x, c1, c2
