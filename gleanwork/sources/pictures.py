"""Readings of pictures at two resolutions: a small one for the gate, a large one for the text.

Decoding, scaling and OCR are injected; PillowDecoder is there where that library is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .extract import OCR

#: The longest side for the gate; the side below which a picture is small, and how much small and other ones are enlarged.
GATE_SIDE = 800
SMALL_SIDE, SMALL_SCALE, LARGE_SCALE = 1600, 1.8, 1.2


class Decoder(Protocol):
    def decode(self, content: bytes) -> tuple[Any, int, int]:
        """A picture, its height and width; raises if it can't be read."""

    def resize(self, picture: Any, height: int, width: int) -> Any: ...


class Reader(Protocol):
    def __call__(self, picture: Any) -> list[tuple[list[tuple[float, float]], str, float | None]]:
        """The text boxes: polygon, text, confidence."""


class PillowDecoder:
    def __init__(self) -> None:
        try:
            from PIL import Image
        except ImportError as e:
            raise ImportError("PillowDecoder needs Pillow; any other Decoder can be given instead") from e
        self.image = Image

    def decode(self, content: bytes):
        import io

        picture = self.image.open(io.BytesIO(content)).convert("RGB")
        return picture, picture.height, picture.width

    def resize(self, picture, height: int, width: int):
        return picture.resize((width, height), self.image.BICUBIC if width > picture.width else self.image.BOX)


def gate_scale(height: int, width: int) -> float:
    return min(1.0, GATE_SIDE / max(height, width, 1))


def text_scale(height: int, width: int) -> float:
    return SMALL_SCALE if max(height, width) < SMALL_SIDE else LARGE_SCALE


def reading(scale: Callable[[int, int], float], make_reader: Callable[[], Reader], make_decoder: Callable[[], Decoder] = PillowDecoder) -> Callable[[Column], Column]:
    """content -> struct of OCR: height and width as decoded, and the boxes that are read after scaling, in the picture's own coordinates.

    Decoder and reader are made once per stream of batches. Pictures that one of them fails on have null fields.
    """

    def one(decoder: Decoder, reader: Reader, content: bytes) -> list:
        picture, height, width = decoder.decode(content)
        s = scale(height, width)
        h, w = max(1, int(height * s)), max(1, int(width * s))
        boxes = reader(picture if s == 1 else decoder.resize(picture, h, w))
        x_back, y_back = (1, 1) if s == 1 else (width / w, height / h)
        return [height, width, [{"poly": [{"x": x * x_back, "y": y * y_back} for x, y in poly], "text": text, "conf": conf} for poly, text, conf in boxes]]

    @F.pandas_udf(OCR)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        decoder, reader = make_decoder(), make_reader()
        for batch in batches:
            rows = []
            for content in batch:
                try:
                    rows.append([None] * 3 if content is None else one(decoder, reader, bytes(content)))
                except Exception:  # noqa: BLE001  a picture that can't be read is one without contents
                    rows.append([None] * 3)
            yield pd.DataFrame(rows, columns=["img_h", "img_w", "boxes"], dtype="object")

    return run
