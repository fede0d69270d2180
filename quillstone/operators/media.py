"""De-identification of image pairs with pluggable codec and face detector.

Both plug-ins may be missing.  Then every pair is rejected with a reason: without a detector no
image may pass as free of faces, and without a codec none may pass as re-encoded.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..functions import fixed

#: Decodes bytes to rows x columns x 3, and encodes back at a quality of 95 without metadata.
Codec = tuple[Callable[[bytes], np.ndarray | None], Callable[[np.ndarray], bytes]]
#: Finds boxes (x, y, w, h) in an image.
Detector = Callable[[np.ndarray], list[tuple[int, int, int, int]]]

READ = "label string, stem string, content binary, width int, height int, digest string, reason string"
OUT = "label string, stem string, content binary, faces array<struct<x:int,y:int,w:int,h:int>>, reason string"


def installed_codec() -> Codec | None:
    """A JPEG codec from an installed imaging library; none if there is none."""
    try:
        import io

        from PIL import Image
    except ImportError:
        return None

    def decode(content: bytes) -> np.ndarray | None:
        try:
            return np.asarray(Image.open(io.BytesIO(content)).convert("RGB"))
        except OSError:
            return None

    def encode(image: np.ndarray) -> bytes:
        out = io.BytesIO()
        Image.fromarray(image).save(out, "JPEG", quality=95)
        return out.getvalue()

    return decode, encode


def installed_detector() -> Detector | None:
    """A frontal-face cascade from an installed vision library, loaded once; none if there is none."""
    try:
        import cv2

        cascade = cv2.CascadeClassifier(cv2.data.haarcascades + "haarcascade_frontalface_default.xml")
    except (ImportError, AttributeError):
        return None
    return lambda image: [tuple(map(int, box)) for box in cascade.detectMultiScale(cv2.cvtColor(image, cv2.COLOR_RGB2GRAY), scaleFactor=1.1, minNeighbors=5, minSize=(40, 40))]


def _smear(plane: np.ndarray, taps: int = 31) -> np.ndarray:
    """A Gaussian blur of ``taps`` by ``taps``, edges mirrored."""
    sigma = 0.3 * ((taps - 1) * 0.5 - 1) + 0.8
    at = np.arange(taps) - taps // 2
    weight = np.exp(-(at**2) / (2 * sigma**2))
    weight /= weight.sum()
    for axis in (0, 1):
        mode = "reflect" if plane.shape[axis] > taps // 2 else "edge"
        pad = [(taps // 2, taps // 2) if a == axis else (0, 0) for a in range(plane.ndim)]
        padded = np.pad(plane, pad, mode=mode)
        plane = sum(w * np.take(padded, range(k, k + plane.shape[axis]), axis=axis) for k, w in enumerate(weight))
    return plane


def _reduced(region: np.ndarray, grid: int) -> np.ndarray:
    """``region`` at ``grid`` x ``grid`` points, each interpolated between the four pixels around it; whole values."""
    for axis in (0, 1):
        n = region.shape[axis]
        at = np.clip((np.arange(grid) + 0.5) * n / grid - 0.5, 0, n - 1)
        low = np.minimum(at.astype(int), max(0, n - 2))
        share = (at - low).reshape([-1 if a == axis else 1 for a in range(region.ndim)])
        region = np.take(region, low, axis) * (1 - share) + np.take(region, np.minimum(low + 1, n - 1), axis) * share
    return np.rint(region)


def pixelated(image: np.ndarray, boxes: list[tuple[int, int, int, int]], margin: float = fixed.FACE_MARGIN, grid: int = 8) -> np.ndarray:
    """``image`` with each box, grown by ``margin``, reduced to ``grid`` x ``grid`` points, shown as cells and blurred."""
    out = image.astype(float)
    height, width = image.shape[:2]
    for x, y, w, h in boxes:
        x0, x1 = max(0, x - int(w * margin)), min(width, x + w + int(w * margin))
        y0, y1 = max(0, y - int(h * margin)), min(height, y + h + int(h * margin))
        if x1 <= x0 or y1 <= y0:
            continue
        small = _reduced(out[y0:y1, x0:x1], grid)
        flat = small[np.ix_(np.arange(y1 - y0) * grid // (y1 - y0), np.arange(x1 - x0) * grid // (x1 - x0))]
        out[y0:y1, x0:x1] = _smear(flat)
    return np.clip(np.rint(out), 0, 255).astype(image.dtype)


def reencoded(images: DataFrame, codec: Callable[[], Codec | None] = installed_codec) -> DataFrame:
    """``images`` (label, stem, content) decoded and encoded anew, which sheds all metadata of the file.

    Gives size, SHA-256 of the decoded pixels (red first, without the size) and the new content, or
    the reason why not.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coding = codec()
        for batch in batches:
            rows = []
            for label, stem, content in zip(batch["label"], batch["stem"], batch["content"], strict=True):
                image = coding[0](bytes(content)) if coding and content is not None else None
                if image is None:
                    rows.append((label, stem, None, None, None, None, f"cannot read {stem}" if coding else "no image codec is installed"))
                else:
                    height, width = image.shape[:2]
                    rows.append((label, stem, coding[1](image), width, height, hashlib.sha256(np.ascontiguousarray(image).tobytes()).hexdigest(), None))
            out = pd.DataFrame(rows, columns=["label", "stem", "content", "width", "height", "digest", "reason"])
            yield out.astype({"width": "Int32", "height": "Int32"})

    return images.select("label", "stem", "content").mapInPandas(read, READ)


def deidentify(images: DataFrame, codec: Callable[[], Codec | None] = installed_codec, detector: Callable[[], Detector | None] = installed_detector, allow_no_face: bool = False, crop_top: float = 0.0) -> DataFrame:
    """``images`` (label, stem, content) as clean JPEGs, or with the reason why not.

    Plug-ins are made once a task.  A crop alone is no leave to go without a face.
    """
    if not 0 <= crop_top < 1:
        raise ValueError("the share to crop must be at least 0 and less than 1")

    def clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coding, find = codec(), detector()
        for batch in batches:
            rows = []
            for label, stem, content in zip(batch["label"], batch["stem"], batch["content"], strict=True):
                image = coding[0](bytes(content)) if coding and content is not None else None
                if coding is None:
                    rows.append((label, stem, None, [], "no image codec is installed"))
                elif image is None:
                    rows.append((label, stem, None, [], f"cannot read {stem}"))
                elif find is None:
                    rows.append((label, stem, None, [], "no face detector is installed"))
                else:
                    image = image[int(image.shape[0] * crop_top) :]
                    faces = find(image)
                    if not faces and not allow_no_face:
                        rows.append((label, stem, None, [], f"no face detected in {stem}"))
                    else:
                        boxes = [dict(zip("xywh", box, strict=True)) for box in faces]
                        rows.append((label, stem, coding[1](pixelated(image, faces)), boxes, None))
            yield pd.DataFrame(rows, columns=["label", "stem", "content", "faces", "reason"])

    return images.select("label", "stem", "content").mapInPandas(clean, OUT)
