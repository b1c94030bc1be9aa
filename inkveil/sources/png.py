"""PNG files as a data source and sink (``spark.read.format("png")``, ``df.write.format("png")``).

Reading: the files of a folder, at any depth, dealt to partitions of about ``partition_bytes`` bytes. A file that can't be
decoded becomes a row with its error.

Writing: covered images (path, data: PNG bytes) as files named after their image. A task writes into a folder of its own, aside; when all tasks are
done, each one's folder is moved into place whole, one rename a task. So a killed, failed or repeated task leaves no file, and no
half of one, in the result; aborting removes what was written aside. Of images of one name in a task, later ones get a number.

Paths are any that ``pyarrow.fs`` opens and that driver and executors share.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from struct import unpack

import numpy as np
from pyarrow import fs
from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Samples of a pixel by the file's colour type: grey, RGB, palette, grey and alpha, RGBA.
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
SCHEMA = "path string, width int, height int, data binary, error string"


def _unfiltered(rows: np.ndarray, step: int) -> np.ndarray:
    """Rows of a filter number and bytes -> the bytes; ``step``: bytes of a pixel."""
    out = np.zeros((len(rows), rows.shape[1] - 1 + step), np.uint8)  # a pixel of zeros on the left
    above = np.zeros(out.shape[1], np.uint8)
    for y, row in enumerate(rows):
        kind, line, own = row[0], row[1:], out[y]
        if kind == 0:
            own[step:] = line
        elif kind == 1:
            own[step:] = np.add.accumulate(line.reshape(-1, step), axis=0, dtype=np.uint8).ravel()
        elif kind == 2:
            own[step:] = line + above[step:]
        else:
            left, up = own.tolist(), above.tolist()
            for i, v in enumerate(line.tolist(), step):
                a, b, c = left[i - step], up[i], up[i - step]
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    near = [(abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c)]
                    guess = min(near)[2]
                left[i] = (v + guess) & 255
            own[:] = left
        above = own
    return out[:, step:]


def decode_png(data: bytes) -> np.ndarray:
    """RGBA of a PNG of 8-bit samples that isn't interlaced."""
    if data[:8] != SIGNATURE:
        raise ValueError("no PNG")
    at, body, palette, clear = 8, [], None, b""
    width = height = depth = colour = interlaced = 0
    while at + 8 <= len(data):
        (n,) = unpack(">I", data[at : at + 4])
        kind, part = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            width, height, depth, colour, _, _, interlaced = unpack(">IIBBBBB", part)
        elif kind == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            clear = part
        elif kind == b"IDAT":
            body.append(part)
        at += 12 + n
    if depth != 8 or interlaced or colour not in SAMPLES:
        raise ValueError(f"PNG of {depth} bits, colour type {colour}, interlacing {interlaced}")
    step = SAMPLES[colour]
    raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, 1 + step * width)
    a = _unfiltered(raw, step).reshape(height, width, step)
    out = np.full((height, width, 4), 255, np.uint8)
    if colour == 3:
        out[..., :3] = palette[a[..., 0]]
        alpha = np.full(256, 255, np.uint8)
        alpha[: len(clear)] = np.frombuffer(clear, np.uint8)
        out[..., 3] = alpha[a[..., 0]]
        return out
    out[..., :3] = a[..., :3] if step > 2 else a[..., :1]
    if step in (2, 4):
        out[..., 3] = a[..., -1]
    return out


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


@dataclass
class Files(InputPartition):
    paths: list[str]

    def __init__(self, paths: list[str]):
        super().__init__(paths)
        self.paths = paths


class PngReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.most = options["path"], int(options.get("partition_bytes", 64 << 20))

    def partitions(self) -> list[Files]:
        """Files in the order of their names, cut where the bytes of a partition are full; at least one each."""
        files, root = _opened(self.path)
        found = [i for i in files.get_file_info(fs.FileSelector(root, recursive=True)) if i.is_file and i.extension.lower() == "png" and "/_" not in i.path[len(root) :]]
        parts: list[Files] = []
        held = self.most
        for info in sorted(found, key=lambda i: i.path):
            if held + info.size > self.most:
                parts.append(Files([]))
                held = 0
            parts[-1].paths.append(info.path)
            held += info.size
        return parts or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        files, _ = _opened(self.path)
        for path in partition.paths:
            try:
                with files.open_input_stream(path) as f:
                    a = decode_png(f.read())
                yield path, a.shape[1], a.shape[0], a.tobytes(), None
            except Exception as e:  # noqa: BLE001  the error is the row's result
                yield path, None, None, None, f"the image can't be decoded: {e}"


@dataclass
class Written(WriterCommitMessage):
    folder: str
    files: int


class PngWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.aside = f"_writing-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> Written:
        files, root = _opened(self.path)
        folder = f"part-{uuid.uuid4().hex}"  # of this attempt alone
        own = f"{root}/{self.aside}/{folder}"
        used: dict[str, int] = {}
        for row in iterator:
            if not used:
                files.create_dir(own, recursive=True)
            name = row["output_name"]
            used[name] = used.get(name, 0) + 1
            if used[name] > 1:
                name = f"{name.removesuffix('.png')} ({used[name]}).png"
            with files.open_output_stream(f"{own}/{name}") as f:
                f.write(row["data"])
        return Written(folder, sum(used.values()))

    def commit(self, messages: list[Written | None]) -> None:
        files, root = _opened(self.path)
        if self.overwrite:
            old = [i.path for i in files.get_file_info(fs.FileSelector(root, allow_not_found=True)) if i.base_name.startswith("part-")]
            for path in old:
                files.delete_dir(path)
        files.create_dir(root, recursive=True)
        for m in messages:
            if m is not None and m.files:
                files.move(f"{root}/{self.aside}/{m.folder}", f"{root}/{m.folder}")
        self._clear(files, root)
        with files.open_output_stream(f"{root}/_SUCCESS"):
            pass

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*_opened(self.path))

    def _clear(self, files: fs.FileSystem, root: str) -> None:
        path = f"{root}/{self.aside}"
        if files.get_file_info(path).type == fs.FileType.Directory:
            files.delete_dir(path)


class Png(DataSource):
    @classmethod
    def name(cls) -> str:
        return "png"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PngReader:
        return PngReader(self.options)

    def writer(self, schema, overwrite: bool) -> PngWriter:
        return PngWriter(self.options, overwrite)
