"""Pixel kernels on numpy arrays: uint8, (h, w) gray or (h, w, 3) blue-green-red.

Borders are mirrored without the edge pixel, as is usual for filters. Results follow the published
definitions of each filter; equality with a particular imaging library to the last bit is not
promised."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def gray(img: np.ndarray) -> np.ndarray:
    if img.ndim == 2:
        return img
    return np.rint(img @ np.array([0.114, 0.587, 0.299])).astype(np.uint8)


def like(plane: np.ndarray, img: np.ndarray) -> np.ndarray:
    """A gray plane with as many channels as img."""
    return plane if img.ndim == 2 else np.repeat(plane[..., None], 3, axis=2)


def one_plane(img: np.ndarray) -> np.ndarray | None:
    """The levels of a picture without colours, of one channel or of three equal ones; else None."""
    if img.ndim == 2:
        return img
    first = img[..., 0]
    return np.ascontiguousarray(first) if all(np.array_equal(first, img[..., i]) for i in (1, 2)) else None


def clip8(x: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(x), 0, 255).astype(np.uint8)


def padded(img: np.ndarray, r: int, mode: str = "reflect") -> np.ndarray:
    if mode == "reflect" and min(img.shape[:2]) <= r:
        mode = "edge"
    return np.pad(img, [(r, r), (r, r)] + [(0, 0)] * (img.ndim - 2), mode=mode)


def shifts(img: np.ndarray, r: int, mode: str = "reflect"):
    """(dy, dx, img moved by them) of a square window."""
    p, (h, w) = padded(img, r, mode), img.shape[:2]
    for dy in range(2 * r + 1):
        for dx in range(2 * r + 1):
            yield dy - r, dx - r, p[dy : dy + h, dx : dx + w]


def separable(img: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    r, (h, w) = len(kernel) // 2, img.shape[:2]
    p = padded(img.astype(np.float64), r)
    rows = sum(k * p[i : i + h] for i, k in enumerate(kernel))
    return sum(k * rows[:, i : i + w] for i, k in enumerate(kernel))


def gaussian(size: int) -> np.ndarray:
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    k = np.exp(-((np.arange(size) - size // 2) ** 2) / (2 * sigma * sigma))
    return k / k.sum()


def blur(img: np.ndarray, size: int = 5) -> np.ndarray:
    return clip8(separable(img, gaussian(size)))


def adaptive(plane: np.ndarray, size: int = 11, c: float = 2) -> np.ndarray:
    """White where a pixel is above its Gaussian neighbourhood less c."""
    return np.where(plane.astype(np.int16) > blur(plane, size).astype(np.int16) - c, 255, 0).astype(np.uint8)


def adaptive_mean(plane: np.ndarray, size: int = 15, c: float = 5) -> np.ndarray:
    """White where a pixel is above the mean of its square less c."""
    mean = clip8(separable(plane, np.full(size, 1 / size)))
    return np.where(plane.astype(np.int16) > mean.astype(np.int16) - c, 255, 0).astype(np.uint8)


def blur_by(img: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian of a given deviation, three deviations wide on either side."""
    r = int(round(3 * sigma))
    k = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma * sigma))
    return clip8(separable(img, k / k.sum()))


def resized(img: np.ndarray, h: int, w: int, cubic: bool = False) -> np.ndarray:
    """The image at another size, pixel centres kept in place; linear or cubic (a = -3/4)."""
    def along(x: np.ndarray, m: int, made: Callable = lambda part: part, kind: type = np.float64) -> np.ndarray:
        """x resized to m rows, some rows at a time."""
        n, some = len(x), max(1, 65_536 // max(1, x[0].size))
        at = (np.arange(m) + 0.5) * n / m - 0.5
        first = np.floor(at).astype(int) - (1 if cubic else 0)
        taps = []
        for i in range(4 if cubic else 2):
            d = np.abs(at - (first + i))
            if cubic:
                k = np.where(d <= 1, 1.25 * d**3 - 2.25 * d**2 + 1, np.where(d < 2, -0.75 * (d**3 - 5 * d**2 + 8 * d - 4), 0))
            else:
                k = np.maximum(1 - d, 0)
            taps.append((k.reshape(-1, *[1] * (x.ndim - 1)), np.clip(first + i, 0, n - 1)))
        out = np.empty((m, *x.shape[1:]), kind)
        for y in range(0, m, some):
            out[y : y + some] = made(sum(k[y : y + some] * x[j[y : y + some]] for k, j in taps))
        return out

    rows = along(img.astype(np.float64), h)
    return np.ascontiguousarray(np.swapaxes(along(np.ascontiguousarray(np.swapaxes(rows, 0, 1)), w, clip8, np.uint8), 0, 1))


def smallest_box(poly: np.ndarray) -> np.ndarray:
    """The four corners of the rectangle of the smallest area around a convex outline: one of its
    sides lies on a side of the outline."""
    best, corners = np.inf, poly
    for a, b in zip(poly, np.roll(poly, -1, axis=0), strict=True):
        d = (b - a) / max(np.hypot(*(b - a)), 1e-12)
        turn = np.array([d, [-d[1], d[0]]])
        flat = poly @ turn.T
        low, high = flat.min(axis=0), flat.max(axis=0)
        if (size := float(np.prod(high - low))) < best:
            best, corners = size, np.array([low, [high[0], low[1]], high, [low[0], high[1]]]) @ turn
    return corners


def otsu_level(plane: np.ndarray) -> int:
    """The level of the largest variance between the two sides."""
    n = np.bincount(plane.ravel(), minlength=256).astype(np.float64)
    below, mass = np.cumsum(n), np.cumsum(n * np.arange(256))
    above = below[-1] - below
    with np.errstate(divide="ignore", invalid="ignore"):
        spread = below * above * (mass / below - (mass[-1] - mass) / above) ** 2
    return int(np.nan_to_num(spread).argmax())


def otsu(plane: np.ndarray) -> np.ndarray:
    return np.where(plane > otsu_level(plane), 255, 0).astype(np.uint8)


def equalise_tiles(plane: np.ndarray, limit: float = 2.0, tiles: int = 8) -> np.ndarray:
    """Contrast-limited equalisation of tiles, blended between tile centres."""
    h, w = plane.shape
    th, tw = -(-h // tiles), -(-w // tiles)
    p = np.pad(plane, [(0, th * tiles - h), (0, tw * tiles - w)], mode="reflect" if min(h, w) > tiles else "edge")
    cells = p.reshape(tiles, th, tiles, tw).swapaxes(1, 2).reshape(tiles * tiles, -1)
    n = np.stack([np.bincount(c, minlength=256) for c in cells]).astype(np.float64)
    cap = max(1.0, limit * cells.shape[1] / 256)
    over = np.maximum(n - cap, 0).sum(axis=1, keepdims=True)
    table = (np.cumsum(np.minimum(n, cap) + over / 256, axis=1) * 255 / cells.shape[1]).reshape(tiles, tiles, 256)
    y, x = np.clip((np.arange(h) + 0.5) / th - 0.5, 0, tiles - 1), np.clip((np.arange(w) + 0.5) / tw - 0.5, 0, tiles - 1)
    y0, x0 = y.astype(int), x.astype(int)
    y1, x1 = np.minimum(y0 + 1, tiles - 1), np.minimum(x0 + 1, tiles - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    at = lambda a, b: table[a[:, None], b[None, :], plane]
    return clip8((at(y0, x0) * (1 - fx) + at(y0, x1) * fx) * (1 - fy) + (at(y1, x0) * (1 - fx) + at(y1, x1) * fx) * fy)


def bilateral(img: np.ndarray, size: int = 9, colour: float = 75, space: float = 75) -> np.ndarray:
    """Weights come from a table by the distance of colours, a whole number; three equal channels are worked on as one."""
    if img.ndim == 3 and (plane := one_plane(img)) is not None:
        return like(_bilateral([plane], size, colour, space, 3)[0], img)
    planes = [img] if img.ndim == 2 else [np.ascontiguousarray(img[..., i]) for i in range(3)]
    out = _bilateral(planes, size, colour, space)
    return out[0] if img.ndim == 2 else np.stack(out, axis=2)


def _bilateral(planes: list[np.ndarray], size: int, colour: float, space: float, times: int = 1) -> list[np.ndarray]:
    """times: how often the distance of levels counts."""
    r = size // 2
    total, weight = [np.zeros(p.shape) for p in planes], np.zeros(planes[0].shape)
    far, k, part = np.empty(weight.shape, np.int16), np.empty_like(weight), np.empty_like(weight)
    levels = np.arange(255 * len(planes) + 1, dtype=np.float64) * times
    for moves in zip(*[shifts(p.astype(np.int16), r) for p in planes], strict=True):
        dy, dx = moves[0][:2]
        if dy * dy + dx * dx <= r * r:
            far[:] = 0
            for (_, _, moved), p in zip(moves, planes, strict=True):
                far += np.abs(moved - p)
            np.take(np.exp(-(levels**2) / (2 * colour * colour) - (dy * dy + dx * dx) / (2 * space * space)), far, out=k, mode="clip")
            weight += k
            for t, (_, _, moved) in zip(total, moves, strict=True):
                t += np.multiply(moved, k, out=part)
    return [clip8(t / weight) for t in total]


def _run_sums(x: np.ndarray, step: int, size: int, n: int) -> np.ndarray:
    """Sums of size values, each step further, from each of the first n places."""
    out, own, start, run, width = None, False, 0, x, 1
    while width <= size:
        if size & width:
            part = run[start * step : start * step + n]
            out, own = (part, False) if out is None else (np.add(out, part, out=out if own else None), True)
            start += width
        if 2 * width <= size:
            run = run[: len(run) - width * step] + run[width * step :]
        width *= 2
    return out


def _run_of(x: np.ndarray, size: int, pick: np.ufunc) -> np.ndarray:
    """pick (maximum, minimum, or) over size rows from each row on."""
    n, width, out = len(x) - size + 1, 1, x
    while 2 * width <= size:
        out = pick(out[:-width], out[width:])
        width *= 2
    return pick(out[:n], out[size - width : size - width + n])


def _settled(plane: np.ndarray, strength: float, patch: int, window: int) -> np.ndarray:
    """Pixels that `non_local_means` surely leaves as they are, on planes with a wide gap between dark and light levels. A pixel of a window
    across the gap weighs exp(-step * step / scale) at most, less by as much for each further place of the patches that lies across. Pixels are
    settled whose window has no other level on their own side, and none across the gap that the patches' other places do not show, too,
    if then all that lies across moves the mean by less than half a level. A window's comparisons are bits of some words a pixel."""
    none, levels = np.zeros(plane.shape, bool), np.flatnonzero(np.bincount(plane.ravel(), minlength=256))
    step, scale, others = int(np.diff(levels).max()), patch * patch * strength * strength, window * window - 1
    far = np.arange(step, 256)
    once = others * float((far * np.exp(-far * far / scale)).max())
    if once * np.exp(-step * step / scale) > 0.49 or window > 64 or patch < 3:
        return none
    (h, w), r, q = plane.shape, window // 2, patch // 2
    light = plane > levels[int(np.diff(levels).argmax())]
    around = lambda x, pick: _run_of(_run_of(padded(x, r), window, pick).T, window, pick).T
    level = lambda side: around(np.where(side, plane, 0), np.maximum) == around(np.where(side, plane, 255), np.minimum)
    same = np.where(light, level(light), level(~light))
    if once <= 0.49 or not same.any():
        return same
    bits, line = padded(light, r).astype(np.uint64), np.zeros((h + 2 * r, w), np.uint64)
    for dx in range(window):
        line |= bits[:, dx : dx + w] << np.uint64(dx)
    mode = "reflect" if min(h, w) > q else "edge"
    rows, some, deep = np.pad(np.arange(h), q, mode=mode), 64 // window, max(8, 20_000 // w)
    left, right = (slice(2 * q, q, -1), slice(w + q - 2, w - 2, -1)) if mode == "reflect" else (slice(q, q + 1), slice(w + q - 1, w + q))
    for y0 in range(0, h, deep):
        n, at = min(deep, h - y0), rows[y0 : y0 + deep + 2 * q]
        alone, across = np.zeros((n, w), np.uint64), np.empty((len(at), w + 2 * q), np.uint64)
        # bits of the row that differ from the pixel: those of the line, turned where it is light
        whole = np.where(light[at], np.uint64((1 << window) - 1), np.uint64(0))
        for dy in range(0, window, some):
            word = line[at + dy] ^ whole
            for i in range(1, min(some, window - dy)):
                word |= (line[at + dy + i] ^ whole) << np.uint64(i * window)
            across[:, q : q + w] = word
            across[:, :q], across[:, w + q :] = across[:, left], across[:, right]
            own, beyond = across[q : q + n], _run_of(across, q, np.bitwise_or)
            seen = _run_of((beyond[:n] | beyond[q + 1 : q + 1 + n]).T, patch, np.bitwise_or).T
            beyond = _run_of(own.T, q, np.bitwise_or).T
            alone |= own[:, q : q + w] & ~(seen | beyond[:, :w] | beyond[:, q + 1 : q + 1 + w])
        same[y0 : y0 + n] &= alone == 0
    return same


#: Weights under e to the power of minus this one count for less than UNSURE in all.
FAINT = 22.0
#: More than single precision and FAINT can put a mean wrong: weights and their products by 1.2e-7, seven additions before a
#: sum goes on in double precision by 3.6e-7, levels less 128, in numerator and denominator.
UNSURE = 2e-4


def _mean_of(plane: np.ndarray, y: np.ndarray, x: np.ndarray, strength: float, patch: int, window: int) -> np.ndarray:
    """`non_local_means` before rounding at the pixels y, x, in double precision, some pixels at a time."""
    (h, w), q = plane.shape, patch // 2
    rows, cols = (np.pad(np.arange(n), q, mode="reflect" if min(h, w) > q else "edge") for n in (h, w))
    around = np.lib.stride_tricks.sliding_window_view(padded(plane, window // 2), (window, window))
    out, place = np.empty(len(y)), np.arange(patch)
    for i in range(0, len(y), 32):
        part = slice(i, i + 32)
        at = rows[y[part, None] + place][:, :, None], cols[x[part, None] + place][:, None, :]
        apart = around[at].astype(np.int32) - plane[at].astype(np.int32)[..., None, None]
        k = np.exp((apart * apart).sum(axis=(1, 2)) / -(patch * patch * strength * strength))
        out[part] = (k * around[y[part], x[part]]).sum(axis=(1, 2)) / k.sum(axis=(1, 2))
    return out


def non_local_means(plane: np.ndarray, strength: float = 10, patch: int = 7, window: int = 21) -> np.ndarray:
    """Mean of the window's pixels, weighted by the likeness of their patches. Sums of squared differences are whole numbers, so
    weights come from a table, in single precision; means that this leaves open are taken again in double. On planes of two levels,
    likenesses are counted. Works on strips of rows, from one row to the next that has pixels which are not `_settled`, as all of a
    thresholded plane are."""
    low, high = int(plane.min()), int(plane.max())
    if low == high:
        return plane.copy()
    settled = _settled(plane, strength, patch, window)
    open_rows = np.flatnonzero(~settled.all(axis=1))
    if not len(open_rows):
        return plane.copy()
    (h, w), r, q, area = plane.shape, window // 2, patch // 2, patch * patch
    steps = int(FAINT * area * strength * strength / (high - low) ** 2) + 1
    counted = steps <= 6 and area < 256 and bool(((plane == low) | (plane == high)).all())
    kind = np.uint8 if counted else np.float32
    wide = w + 2 * r
    given = np.concatenate([padded((plane == high) if counted else plane, r).astype(kind).ravel(), np.zeros(2 * r, kind)])
    values = given if counted else given - np.float32(128)
    mode = "reflect" if min(h, w) > q else "edge"
    rows_of = np.pad(np.arange(h), q, mode=mode)
    left, right = (slice(2 * q, q, -1), slice(w + q - 2, w - 2, -1)) if mode == "reflect" else (slice(q, q + 1), slice(w + q - 1, w + q))
    table = np.exp(-np.arange(0 if counted else int(FAINT * area * strength * strength) + 2) / (area * strength * strength)).astype(np.float32)
    table[-1:] = 0
    out, deep = plane.copy(), max(8, (60_000 if counted else 40_000) // wide)
    while len(open_rows):
        y0 = int(open_rows[0])
        y1 = min(y0 + deep, int(open_rows[-1]) + 1)
        open_rows = open_rows[open_rows >= y1]
        n, first, last = (y1 - y0) * wide, max(0, y0 - q), min(h, y1 + q)
        own = np.zeros((last - first, wide), kind)
        own[:, :w] = given[: (h + 2 * r) * wide].reshape(-1, wide)[r + first : r + last, r : r + w]
        own = own.ravel()
        # squared differences of the rows from y0 - q to y1 + q, mirrored at the picture's borders
        square = np.zeros((y1 - y0 + 2 * q + 1) * wide, kind)
        at = (first - y0 + q) * wide + q
        inner, grid = square[at : at + len(own)], square[: (y1 - y0 + 2 * q) * wide].reshape(-1, wide)
        beyond = [(i, int(rows_of[y0 + i]) - y0 + q) for i in range(y1 - y0 + 2 * q) if not 0 <= y0 - q + i < h]
        if counted:
            n_all, n_high = np.zeros((steps, n), np.uint16), np.zeros((steps, n), np.uint16)
            some_all, some_high = np.zeros((steps, n), np.uint8), np.zeros((steps, n), np.uint8)
        else:
            total, weight, place, k = np.zeros(n), np.zeros(n), np.empty(n, np.intp), np.empty(n, np.float32)
            part, share = np.zeros(n, np.float32), np.zeros(n, np.float32)
        tried = 0
        for dy in range(window):
            for dx in range(window):
                start = (first + dy) * wide + dx
                moved = given[start : start + len(own)]
                if counted:
                    np.bitwise_xor(moved, own, out=inner)
                else:
                    np.subtract(moved, own, out=inner)
                    np.multiply(inner, inner, out=inner)
                grid[:, :q], grid[:, w + q : w + 2 * q] = grid[:, left], grid[:, right]
                for i, j in beyond:
                    grid[i] = grid[j]
                upright = _run_sums(square, wide, patch, n + wide)
                likeness = _run_sums(upright, 1, patch, n)
                start = (y0 + dy) * wide + dx
                tried += 1
                if counted:
                    bits = values[start : start + n]
                    for c in range(steps):
                        hit = (likeness == c).view(np.uint8)
                        some_all[c] += hit
                        some_high[c] += np.bitwise_and(hit, bits, out=hit)
                    if tried % 255 == 0 or tried == window * window:
                        n_all += some_all
                        n_high += some_high
                        some_all[:], some_high[:] = 0, 0
                else:
                    np.copyto(place, likeness, casting="unsafe")
                    np.take(table, place, out=k, mode="clip")
                    share += k
                    part += np.multiply(k, values[start : start + n], out=k)
                    if tried % 7 == 0 or tried == window * window:
                        weight += share
                        total += part
                        share[:], part[:] = 0, 0
        if counted:
            each = np.exp(-np.arange(steps) * ((high - low) ** 2 / (area * strength * strength)))
            weight = each @ n_all
            total = (low - 128) * weight + (high - low) * (each @ n_high)
        means = (total / np.maximum(weight, 1e-300) + 128).reshape(-1, wide)[:, :w]
        out[y0:y1] = np.where(settled[y0:y1], plane[y0:y1], clip8(means))
        y, x = np.nonzero((np.abs(means - np.floor(means) - 0.5) < UNSURE) & ~settled[y0:y1])
        out[y + y0, x] = clip8(_mean_of(plane, y + y0, x, strength, patch, window))
    return out


def dilate(mask: np.ndarray, size: int = 3) -> np.ndarray:
    p = np.pad(mask, [(size // 2, size - 1 - size // 2)] * 2)
    h, w = mask.shape
    return np.max([p[i : i + h, j : j + w] for i in range(size) for j in range(size)], axis=0)


def erode(mask: np.ndarray, size: int = 3) -> np.ndarray:
    """The dual of dilate: an even window reaches to the other side."""
    return 255 - dilate(255 - mask[::-1, ::-1], size)[::-1, ::-1]


def closed(mask: np.ndarray, size: int = 2) -> np.ndarray:
    return erode(dilate(mask, size), size)


def opened(mask: np.ndarray, size: int = 2) -> np.ndarray:
    return 255 - closed(255 - mask, size)


def sharpened(img: np.ndarray) -> np.ndarray:
    """Nine times the pixel less its neighbours, a fifth of it."""
    near = sum(m for _, _, m in shifts(img.astype(np.float64), 1))
    return clip8((10 * img.astype(np.float64) - near) / 5)


def laplacian(plane: np.ndarray) -> np.ndarray:
    p, (h, w) = padded(plane.astype(np.float64), 1), plane.shape
    return p[:h, 1 : w + 1] + p[2:, 1 : w + 1] + p[1 : h + 1, :w] + p[1 : h + 1, 2:] - 4 * p[1 : h + 1, 1 : w + 1]


def canny(plane: np.ndarray, low: float, high: float) -> np.ndarray:
    """Edges: ridges of the gradient above low that hang together with one above high."""
    p, (h, w) = padded(plane.astype(np.int32), 1, "edge"), plane.shape
    at = lambda dy, dx: p[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w]
    gx = at(-1, 1) + 2 * at(0, 1) + at(1, 1) - at(-1, -1) - 2 * at(0, -1) - at(1, -1)
    gy = at(1, -1) + 2 * at(1, 0) + at(1, 1) - at(-1, -1) - 2 * at(-1, 0) - at(-1, 1)
    strength = np.abs(gx) + np.abs(gy)
    m = np.pad(strength, 1)
    side = lambda dy, dx: m[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w]
    ax, ay = np.abs(gx), np.abs(gy)
    flat, steep = ay < ax * 0.41421356, ay > ax * 2.41421356
    same = (gx >= 0) == (gy >= 0)
    before = np.where(flat, side(0, -1), np.where(steep, side(-1, 0), np.where(same, side(-1, -1), side(-1, 1))))
    after = np.where(flat, side(0, 1), np.where(steep, side(1, 0), np.where(same, side(1, 1), side(1, -1))))
    weak = (strength > low) & (strength > before) & (strength >= after)
    parts = components(weak)
    keep = np.zeros(parts.max() + 1, bool)
    keep[parts[weak & (strength > high)]] = True
    keep[0] = False
    return np.where(keep[parts], 255, 0).astype(np.uint8)


def components(mask: np.ndarray, corners: bool = True) -> np.ndarray:
    """Numbers from 1 of the connected parts (over corners too, if wanted), 0 elsewhere: each run of a row
    takes the smallest number around it and then that number's own, until nothing changes."""
    mask = np.asarray(mask, bool)
    first = mask.copy()
    first[:, 1:] &= ~mask[:, :-1]
    own = np.where(mask, np.cumsum(first).reshape(mask.shape), 0)
    parent = np.arange(int(own.max(initial=0)) + 1)
    above, below = mask[:-1], mask[1:]
    upright = above & below & (first[:-1] | first[1:])
    links = [np.stack([own[:-1][upright], own[1:][upright]])]
    if corners:
        for one, other in ((slice(None, -1), slice(1, None)), (slice(1, None), slice(None, -1))):
            only = above[:, one] & below[:, other] & ~above[:, other] & ~below[:, one]
            links.append(np.stack([own[:-1, one][only], own[1:, other][only]]))
    a, b = np.concatenate(links, axis=1)
    while len(a):
        a, b = parent[a], parent[b]
        live = a != b
        a, b = a[live], b[live]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(parent, parent[parent]):
            parent = parent[parent]
    number = np.cumsum(parent == np.arange(len(parent))) - 1
    return number[parent][own]


def n_outlines(mask: np.ndarray) -> int:
    """Outer outlines and outlines of holes."""
    around = components(np.pad(np.asarray(mask) == 0, 1, constant_values=True), corners=False)
    return int(components(mask).max() + around.max() - 1)


def _bent(line: np.ndarray, side: int, rounds: int = 8) -> np.ndarray:
    """Without points at which a line from left to right goes straight on or turns to the wrong side."""
    for _ in range(rounds):
        d = np.diff(line, axis=0)
        keep = np.ones(len(line), bool)
        keep[1:-1] = side * (d[:-1, 0] * d[1:, 1] - d[:-1, 1] * d[1:, 0]) > 0
        if keep.all():
            break
        line = line[keep]
    return line


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull of (n, 2) points, in order around."""
    line = points[np.lexsort((points[:, 1], points[:, 0]))]
    turn = np.diff(line[:, 0]) != 0
    if len(line):  # no other point of a column is a corner, and none that its neighbours' line passes outside
        ends = [line[np.concatenate([[True], turn])], line[np.concatenate([turn, [True]])]]
        line = np.concatenate([_bent(part, side) for part, side in zip(ends, (1, -1), strict=True)])
    pts = sorted(set(map(tuple, line.tolist())))
    if len(pts) < 3:
        return np.array(pts, float)

    def chain(seq):
        out = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(chain(pts) + chain(pts[::-1]), float)


def area(poly: np.ndarray) -> float:
    x, y = poly[:, 0], poly[:, 1]
    return abs(float(x @ np.roll(y, -1) - y @ np.roll(x, -1))) / 2


def perimeter(poly: np.ndarray) -> float:
    return float(np.hypot(*(poly - np.roll(poly, -1, axis=0)).T).sum())


def simplified(poly: np.ndarray, tolerance: float) -> np.ndarray:
    """Fewest corners by Douglas and Peucker, started at the two corners farthest apart."""
    def keep(line):
        if len(line) < 3:
            return [0]
        a, d = line[0], line[-1] - line[0]
        off = np.abs(d[0] * (line[:, 1] - a[1]) - d[1] * (line[:, 0] - a[0])) / max(np.hypot(*d), 1e-12)
        i = int(off.argmax())
        return [0] if off[i] <= tolerance else keep(line[: i + 1]) + [i + k for k in keep(line[i:])]

    if len(poly) < 4:
        return poly
    span = ((poly[:, None] - poly[None]) ** 2).sum(axis=2)
    i, j = sorted(np.unravel_index(span.argmax(), span.shape))
    round_ = np.concatenate([poly[i:], poly[: i + 1]])
    first = keep(round_[: j - i + 1])
    second = keep(round_[j - i :])
    return round_[first + [j - i + k for k in second]]


def ordered(quad: np.ndarray) -> np.ndarray:
    """Top left, top right, bottom right, bottom left."""
    s, d = quad.sum(axis=1), quad[:, 1] - quad[:, 0]
    return quad[[s.argmin(), d.argmin(), s.argmax(), d.argmax()]]


def warp(img: np.ndarray, quad: np.ndarray) -> np.ndarray:
    """The upright picture of a quad, by the homography that maps its corners, bilinear."""
    q = ordered(np.asarray(quad, float))
    side = lambda a, b: int(np.hypot(*(q[a] - q[b])))
    w, h = max(side(2, 3), side(1, 0)), max(side(1, 2), side(0, 3))
    if not w or not h:
        return img[:0, :0]
    target = [(0, 0), (w - 1, 0), (w - 1, h - 1), (0, h - 1)]
    rows, want = [], []
    for (u, v), (x, y) in zip(target, q, strict=True):
        rows += [[u, v, 1, 0, 0, 0, -x * u, -x * v], [0, 0, 0, u, v, 1, -y * u, -y * v]]
        want += [x, y]
    m = np.append(np.linalg.lstsq(np.array(rows, float), np.array(want), rcond=None)[0], 1).reshape(3, 3)
    u, v = np.meshgrid(np.arange(w), np.arange(h))
    x, y, z = m @ np.stack([u.ravel(), v.ravel(), np.ones(u.size)])
    return sampled(img, (x / z).reshape(h, w), (y / z).reshape(h, w))


def sampled(img: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The image at the places x, y, bilinear, one channel at a time; outside it the nearest pixel."""
    h, w = img.shape[:2]
    x, y = np.clip(np.nan_to_num(x), 0, w - 1), np.clip(np.nan_to_num(y), 0, h - 1)
    x0, y0 = x.astype(np.int32), y.astype(np.int32)
    fx, fy = x - x0, y - y0
    gx, gy = 1 - fx, 1 - fy
    top, below = y0 * w + x0, np.minimum(y0 + 1, h - 1) * w + x0
    right = x0 < w - 1

    def plane(values: np.ndarray) -> np.ndarray:
        at = np.ascontiguousarray(values).ravel().take
        return clip8((at(top) * gx + at(top + right) * fx) * gy + (at(below) * gx + at(below + right) * fx) * fy)

    return plane(img) if img.ndim == 2 else np.stack([plane(img[..., c]) for c in range(img.shape[2])], axis=2)


def rotated(img: np.ndarray, degrees: float) -> np.ndarray:
    """Turned about the centre, counter-clockwise; the border is repeated outwards."""
    h, w = img.shape[:2]
    c, s = np.cos(np.radians(degrees)), np.sin(np.radians(degrees))
    x, y = np.meshgrid(np.arange(w) - w // 2, np.arange(h) - h // 2)
    return sampled(img, c * x - s * y + w // 2, s * x + c * y + h // 2)


def line_angles(edges: np.ndarray, votes: int = 200) -> np.ndarray:
    """Angles in degrees of straight lines with more than `votes` edge pixels, upright ones and
    level ones both near 0."""
    y, x = np.nonzero(edges)
    t = np.radians(np.arange(180))
    far = int(np.hypot(*edges.shape)) + 1
    found, some = [], max(1, 65_536 // max(1, len(x)))
    for first in range(0, 180, some):
        c, s = np.cos(t[first : first + some, None]), np.sin(t[first : first + some, None])
        at = np.rint(x * c + y * s).astype(int) + far + np.arange(len(c))[:, None] * (2 * far + 1)
        n = np.bincount(at.ravel(), minlength=len(c) * (2 * far + 1)).reshape(len(c), -1)
        for a, lines in enumerate((n > votes).sum(axis=1).tolist(), first):
            found += [a - 90 if 45 <= a <= 135 else a] * lines
    return np.array(found, float)


def hsv(img: np.ndarray) -> np.ndarray:
    """Hue 0 to 360, saturation 0 to 1, value 0 to 255."""
    b, g, r = np.moveaxis(img.astype(np.float64), 2, 0)
    v = np.max([b, g, r], axis=0)
    d = v - np.min([b, g, r], axis=0)
    safe = np.where(d > 0, d, 1)
    h = np.where(v == r, (g - b) / safe, np.where(v == g, 2 + (b - r) / safe, 4 + (r - g) / safe)) * 60 % 360
    return np.stack([np.where(d > 0, h, 0), d / np.maximum(v, 1e-9), v], axis=2)


def from_hsv(x: np.ndarray) -> np.ndarray:
    h, s, v = np.moveaxis(x, 2, 0)
    def channel(n):
        k = (n + h / 60) % 6
        return v - v * s * np.clip(np.minimum(k, 4 - k), 0, 1)
    return clip8(np.stack([channel(1), channel(3), channel(5)], axis=2))


_XYZ = np.array([[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169], [0.019334, 0.119193, 0.950227]])
_WHITE = _XYZ.sum(axis=1)


def lab(img: np.ndarray) -> np.ndarray:
    """CIE L 0 to 100, a, b."""
    c = np.arange(256) / 255.0
    xyz = np.where(c > 0.04045, ((c + 0.055) / 1.055) ** 2.4, c / 12.92)[img[..., ::-1]] @ _XYZ.T / _WHITE
    f = np.where(xyz > 216 / 24389, np.cbrt(xyz), (24389 / 27 * xyz + 16) / 116)
    return np.stack([116 * f[..., 1] - 16, 500 * (f[..., 0] - f[..., 1]), 200 * (f[..., 1] - f[..., 2])], axis=2)


def from_lab(x: np.ndarray) -> np.ndarray:
    fy = (x[..., 0] + 16) / 116
    f = np.stack([fy + x[..., 1] / 500, fy, fy - x[..., 2] / 200], axis=2)
    xyz = np.where(f > 6 / 29, f**3, (116 * f - 16) * 27 / 24389) * _WHITE
    c = np.clip(xyz @ np.linalg.inv(_XYZ).T, 0, 1)
    return clip8(np.where(c > 0.0031308, 1.055 * c ** (1 / 2.4) - 0.055, c * 12.92)[..., ::-1] * 255)


#: Without colours: L of each level in 255 parts, and the level of each such L.
LIGHT = clip8(lab(np.repeat(np.arange(256, dtype=np.uint8)[None, :, None], 3, axis=2))[0, :, 0] * 2.55)


def level_of_light(light: np.ndarray) -> np.ndarray:
    """Levels of an L in 255 parts, 0 to 255, without colours."""
    return from_lab(np.stack([light / 2.55, *np.zeros((2, *light.shape))], axis=-1)[None])[0, :, 0]


def yuv(img: np.ndarray) -> np.ndarray:
    """Luma 0 to 255, and both differences about 128."""
    b, g, r = np.moveaxis(img.astype(np.float64), 2, 0)
    y = 0.299 * r + 0.587 * g + 0.114 * b
    return np.stack([y, 0.492 * (b - y) + 128, 0.877 * (r - y) + 128], axis=2)


def from_yuv(x: np.ndarray) -> np.ndarray:
    y, u, v = np.moveaxis(x, 2, 0)
    b, r = y + (u - 128) / 0.492, y + (v - 128) / 0.877
    return clip8(np.stack([b, (y - 0.299 * r - 0.114 * b) / 0.587, r], axis=2))
