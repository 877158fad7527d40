"""Work on pixels inside tasks: tensors for detectors and embedders, alignment of faces, batched inference.

Models aren't shipped: ``run_model`` takes a path that all executors see and one ONNX session
is opened in each task. Decoding of pictures is left to what is installed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Where eyes, nose and corners of the mouth lie in an aligned face of 112 pixels.
ALIGNED = np.array([[38.2946, 51.6963], [73.5318, 51.5014], [56.0252, 71.7366], [41.5493, 92.3655], [70.7299, 92.2041]])


def oriented(image: np.ndarray, orientation: int) -> np.ndarray:
    """A stored picture (height, width, channels) turned upright."""
    turns = {1: lambda x: x, 2: lambda x: x[:, ::-1], 3: lambda x: x[::-1, ::-1], 4: lambda x: x[::-1], 5: lambda x: x.swapaxes(0, 1), 6: lambda x: np.rot90(x, -1), 7: lambda x: np.rot90(x, 2).swapaxes(0, 1), 8: lambda x: np.rot90(x)}
    return np.ascontiguousarray(turns.get(orientation, turns[1])(image))


def sampled(image: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bilinear samples at (x, y); black outside."""
    h, w = image.shape[:2]
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    fx, fy = (x - x0)[..., None], (y - y0)[..., None]

    def at(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        inside = (i >= 0) & (i < w) & (j >= 0) & (j < h)
        return np.where(inside[..., None], image[np.clip(j, 0, h - 1), np.clip(i, 0, w - 1)], 0).astype(np.float64)

    return (at(x0, y0) * (1 - fx) + at(x0 + 1, y0) * fx) * (1 - fy) + (at(x0, y0 + 1) * (1 - fx) + at(x0 + 1, y0 + 1) * fx) * fy


def fit_similarity(src: np.ndarray, dst: np.ndarray) -> tuple[float, float, float, float] | None:
    """(a, b, tx, ty) that take src to dst: x' = a x - b y + tx, y' = b x + a y + ty."""
    if len(src) < 2:
        return None
    ms, md = src.mean(axis=0), dst.mean(axis=0)
    s, d = src - ms, dst - md
    norm = float((s * s).sum())
    if norm < 1e-12:
        return None
    a, b = float((s * d).sum()) / norm, float((s[:, 0] * d[:, 1] - s[:, 1] * d[:, 0]).sum()) / norm
    return a, b, float(md[0] - a * ms[0] + b * ms[1]), float(md[1] - b * ms[0] - a * ms[1])


def aligned_face(image: np.ndarray, landmarks: np.ndarray, size: int = 112) -> np.ndarray | None:
    """The face warped so that its five landmarks lie where an embedder expects them."""
    t = fit_similarity(ALIGNED * (size / 112), landmarks)
    if t is None:
        return None
    a, b, tx, ty = t
    y, x = np.mgrid[0:size, 0:size].astype(np.float64)
    return sampled(image, a * x - b * y + tx, b * x + a * y + ty)


def cropped_face(image: np.ndarray, box: tuple[float, float, float, float], size: int = 112) -> np.ndarray:
    """A face by its box alone, where there are no landmarks."""
    x1, y1, x2, y2 = box
    y, x = np.mgrid[0:size, 0:size].astype(np.float64)
    return sampled(image, x1 + (x + 0.5) * (x2 - x1) / size - 0.5, y1 + (y + 0.5) * (y2 - y1) / size - 0.5)


def detector_tensor(image: np.ndarray, target: int = 640) -> tuple[np.ndarray, float]:
    """(1, 3, target, target) floats of a letterboxed picture, and the scale it was shrunk by."""
    h, w = image.shape[:2]
    scale = min(target / w, target / h)
    nw, nh = max(1, int(w * scale + 0.5)), max(1, int(h * scale + 0.5))
    y, x = np.mgrid[0:nh, 0:nw].astype(np.float64)
    small = sampled(image, np.minimum((x + 0.5) / nw * w - 0.5, w - 1).clip(0), np.minimum((y + 0.5) / nh * h - 0.5, h - 1).clip(0))
    full = np.zeros((target, target, 3))
    full[:nh, :nw] = small[..., :3]
    return ((full - 127.5) / 128).transpose(2, 0, 1)[None].astype(np.float32), scale


def embedder_tensor(faces: list[np.ndarray]) -> np.ndarray:
    return ((np.stack(faces)[..., :3] - 127.5) / 127.5).transpose(0, 3, 1, 2).astype(np.float32)


def unit(v: np.ndarray) -> np.ndarray:
    norm = float(np.sqrt((v * v).sum()))
    return v / norm if norm > 1e-12 else v


def _infer(batches: Iterator[pa.RecordBatch], model: str, shape: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    import onnxruntime

    session = onnxruntime.InferenceSession(model, providers=["CPUExecutionProvider"])
    name = session.get_inputs()[0].name
    for batch in batches:
        for lo in range(0, batch.num_rows, 32):
            part = batch.slice(lo, 32)
            out: list[list[float] | None] = []
            tensors = [np.frombuffer(t, np.float32).reshape(shape) for t in part.column("tensor").to_pylist()]
            try:
                out = [unit(v).tolist() for v in session.run(None, {name: np.stack(tensors)})[0]]
            except Exception:  # noqa: BLE001  one bad face must not cost the others theirs
                for t in tensors:
                    try:
                        out.append(unit(session.run(None, {name: t[None]})[0][0]).tolist())
                    except Exception:  # noqa: BLE001
                        out.append(None)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(out, pa.list_(pa.float32()))], names=["id", "embedding"])


def run_model(tensors: DataFrame, model: str, shape: tuple[int, ...] = (3, 112, 112)) -> DataFrame:
    """(id, embedding) of (id, tensor): unit vectors in batches; a face that fails gets null."""
    return tensors.select("id", "tensor").mapInArrow(partial(_infer, model=model, shape=shape), "id long, embedding array<float>")
