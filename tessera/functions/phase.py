"""Shifts between images: phase correlation over batches, fractions of a pixel, warps between block centres. Small NumPy helpers of the tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

Shape = tuple[int, int]
#: Pixels of the frames that are transformed at once.
AT_ONCE = 1 << 22


def images(column: pa.Array, shape: Shape) -> np.ndarray:
    """A batch's array column as (rows, height, width)."""
    flat = column.flatten()
    if column.null_count or flat.null_count or len(flat) != len(column) * shape[0] * shape[1]:
        raise ValueError(f"every image must have {shape[0]} x {shape[1]} values")
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), *shape)


def conjugate_spectra(images: np.ndarray) -> np.ndarray:
    """What frames are correlated with; worked out once for each reference."""
    return np.conj(np.fft.fft2(np.asarray(images, dtype=float)))


def phase_shifts(frames: np.ndarray, references: np.ndarray, limit: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """dy, dx, peak of shape (frames, references): by how many whole pixels each frame is moved against each reference.

    ``references`` are conjugate spectra; shifts beyond ``limit`` pixels are not looked at.
    """
    n, h, w = frames.shape
    dy, dx, peak = (np.zeros((n, len(references)), dtype=t) for t in ("int32", "int32", "float64"))
    y, x = (np.where(np.arange(m) > m // 2, np.arange(m) - m, np.arange(m)) for m in (h, w))
    far = None if limit is None else (np.abs(y)[:, None] > limit) | (np.abs(x)[None, :] > limit)
    step = max(1, AT_ONCE // (h * w))
    for lo in range(0, n, step):
        f = np.fft.fft2(frames[lo : lo + step].astype(float))
        for k, r in enumerate(references):
            cross = f * r
            c = np.fft.ifft2(cross / np.maximum(np.abs(cross), 1e-12)).real
            if far is not None:
                c[:, far] = -np.inf
            at = c.reshape(len(c), -1).argmax(axis=1)
            rows = slice(lo, lo + len(c))
            dy[rows, k], dx[rows, k], peak[rows, k] = y[at // w], x[at % w], c.reshape(len(c), -1)[np.arange(len(c)), at]
    return dy, dx, peak


def rolled_back(frames: np.ndarray, dy: np.ndarray, dx: np.ndarray) -> np.ndarray:
    """Each frame moved back by its own shift, round the edges."""
    h, w = frames.shape[1:]
    rows = (np.arange(h)[None, :] + np.asarray(dy)[:, None]) % h
    columns = (np.arange(w)[None, :] + np.asarray(dx)[:, None]) % w
    return frames[np.arange(len(frames))[:, None, None], rows[:, :, None], columns[:, None, :]]


def subpixel_shift(frame: np.ndarray, reference: np.ndarray, upsample: int = 10) -> tuple[float, float]:
    """(dy, dx) of a frame against a reference to 1 / upsample pixel.

    The phase correlation is first searched on whole pixels; about its peak it is then evaluated on the fine grid by two small
    matrix products, over one and a half pixels.
    """
    cross = np.fft.fft2(np.asarray(frame, dtype=float)) * np.conj(np.fft.fft2(np.asarray(reference, dtype=float)))
    cross /= np.maximum(np.abs(cross), 100 * np.finfo(float).eps)
    c = np.abs(np.fft.ifft2(cross))
    h, w = c.shape
    whole = np.array(np.unravel_index(int(np.argmax(c)), c.shape), dtype=float)
    whole -= np.where(whole > np.fix(np.array([h, w]) / 2), [h, w], 0)
    if upsample <= 1:
        return float(whole[0]), float(whole[1])
    points = int(np.ceil(1.5 * upsample))
    fine = (np.arange(points) - points // 2) / upsample
    ky, kx = (2j * np.pi * np.fft.fftfreq(m) for m in (h, w))
    z = np.exp(np.outer(whole[0] + fine, ky)) @ cross @ np.exp(np.outer(kx, whole[1] + fine))
    i, j = np.unravel_index(int(np.argmax(np.abs(z))), z.shape)
    return float(whole[0] + fine[i]), float(whole[1] + fine[j])


def stretched(values: np.ndarray, size: tuple[int, int]) -> np.ndarray:
    """A small grid of values spread over ``size`` points by bilinear interpolation, corner on corner."""
    for axis, m in enumerate(size):
        n = values.shape[axis]
        at = np.zeros(m) if m == 1 or n == 1 else np.arange(m) * ((n - 1) / (m - 1))
        low = np.minimum(at.astype(int), n - 1)
        high, part = np.minimum(low + 1, n - 1), at - low
        a, b = np.take(values, low, axis), np.take(values, high, axis)
        part = part.reshape([-1 if k == axis else 1 for k in range(values.ndim)])
        values = a + (b - a) * part
    return values


def displacement(centres: list[int], across: list[int], dy: np.ndarray, dx: np.ndarray, shape: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Row and column shifts of every pixel from those of the blocks at the given centres; beyond the outer centres they stay as there."""
    out = []
    for v in (dy, dx):
        inner = stretched(np.asarray(v, dtype=float).reshape(len(centres), len(across)), (max(1, max(centres) - min(centres)), max(1, max(across) - min(across))))
        pads = [(max(0, min(c)), max(0, m - k - max(0, min(c)))) for c, m, k in zip((centres, across), shape, inner.shape)]
        out.append(np.pad(inner, pads, mode="edge")[: shape[0], : shape[1]])
    return out[0], out[1]


def warped(frame: np.ndarray, dy: np.ndarray, dx: np.ndarray) -> np.ndarray:
    """The frame read at each pixel plus its displacement, by bilinear interpolation, edges repeated."""
    h, w = frame.shape
    y = np.clip(np.arange(h, dtype=float)[:, None] + dy, 0, h - 1)
    x = np.clip(np.arange(w, dtype=float)[None, :] + dx, 0, w - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    a, b = y - y0, x - x0
    f = frame.astype(float)
    top, bottom = f[y0, x0] * (1 - b) + f[y0, x1] * b, f[y1, x0] * (1 - b) + f[y1, x1] * b
    return top * (1 - a) + bottom * a
