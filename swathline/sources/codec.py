"""Bytes of cubes, frames and headers on any file system that pyarrow opens; used inside tasks and by the planner."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np

# Header 'data type' code to numpy type; the complex codes 6 and 9 are not read.
TYPES = {1: "u1", 2: "<i2", 3: "<i4", 4: "<f4", 5: "<f8", 12: "<u2", 13: "<u4", 14: "<i8", 15: "<u8"}
# Fixed values of the raw frame: samples, bands.
FRAME_SAMPLES, FRAME_BANDS = 1280, 327


def file_system(path: str):
    """File system and name of a path as Spark writes it: plain or ``file:`` paths are local (blanks may be escaped), and the
    cluster scheme ``s3a`` is what pyarrow calls ``s3``."""
    from urllib.parse import unquote

    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + unquote(path.removeprefix("file:")).lstrip("/")
    if "://" not in path:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(store_uri(path))


def store_uri(path: str) -> str:
    scheme, rest = path.split("://", 1)
    return f"{'s3' if scheme in ('s3a', 's3n') else scheme}://{rest}"


def _spelled(path: str, name: str, root: str) -> str:
    """``name``, found below ``root``, as a path of the kind that ``path`` is."""
    return path.rstrip("/") + name.removeprefix(root.rstrip("/")) if name != root else path


def opened(path: str):
    """Random-access file on any file system pyarrow knows."""
    system, name = file_system(path)
    return system.open_input_file(name)


def take(f, offset: int, n: int) -> bytes:
    f.seek(offset)
    return f.read(n)


def size_of(path: str) -> int:
    system, name = file_system(path)
    return system.get_file_info(name).size


def files_below(folder: str, ending: str) -> list[str]:
    """Files whose names end so, but for those of writing attempts; a file stands for itself."""
    from pyarrow import fs

    system, root = file_system(folder)
    if system.get_file_info(root).type == fs.FileType.File:
        return [folder]
    found = system.get_file_info(fs.FileSelector(root, recursive=True))
    return [_spelled(folder, f.path, root) for f in found if f.type == fs.FileType.File and f.path.endswith(ending) and "/_attempts/" not in f.path]


def sequence_order(paths: list[str]) -> list[str]:
    """Cubes in sequence order: a folder counts if it holds one cube; folders by the integer after the last '-' of their name
    (or the whole name), those without one last, equal ones by name."""
    by_folder = defaultdict(list)
    for path in paths:
        by_folder[path.rpartition("/")[0]].append(path)

    def place(folder: str) -> tuple:
        root, _, name = folder.rpartition("/")
        number = re.search(r"(?:^|-)([0-9]+)$", name)
        return root, number is None, int(number[1]) if number else 0, folder

    return [by_folder[f][0] for f in sorted(by_folder, key=place) if len(by_folder[f]) == 1]


def parse_header(content: str) -> dict[str, str] | None:
    """'key = value' lines after 'ENVI'; a second '=' ends the value, the last of repeated keys wins. Nothing for other files."""
    first, *rows = content.replace("\r\n", "\n").split("\n")
    if first.strip() != "ENVI":
        return None
    return {p[0].strip(): p[1].strip() for p in (row.split("=") for row in rows) if len(p) > 1}


# Header entry of a cube whose last line was cut off: so many samples of that line are pixels, zeros fill up the rest.
LAST_SAMPLES = "samples of last line"


def header_values(path: str) -> dict[str, str] | None:
    """Values of 'x.bil.hdr' or 'x.hdr' beside 'x.bil', nothing without such a file or if it is another kind of file."""
    system, name = file_system(path)
    for candidate in (f"{name}.hdr", f"{name.removesuffix('.bil')}.hdr"):
        try:
            with system.open_input_stream(candidate) as f:
                return parse_header(f.read().decode())
        except FileNotFoundError:
            continue
    return None


def cube_header(path: str) -> dict:
    """Sizes and type of a cube; without a usable header the cube is refused."""
    kv = header_values(path)
    try:
        sizes = {k: int(kv[k]) for k in ("lines", "samples", "bands")}
        last = int(kv.get(LAST_SAMPLES, sizes["samples"]))
        return {**sizes, "last_samples": last, "data_type": int(kv["data type"]), "interleave": kv.get("interleave", "bil")}
    except (TypeError, KeyError, ValueError):
        raise ValueError(f"no usable header: {path}") from None


def last_samples(path: str) -> int | None:
    """Pixels of a raw frame's last line, where a header beside it tells that it was cut off."""
    try:
        kv = header_values(path)
    except UnicodeDecodeError:
        return None
    return int(kv[LAST_SAMPLES]) if kv and LAST_SAMPLES in kv else None


def shape_of(header: dict) -> dict:
    return {k: header[k] for k in ("samples", "bands", "data_type", "interleave")}


def read_lines(path: str, header: dict, start: int, count: int, bands: list[int] | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """Lines of a cube as samples by bands, a last line that was cut off with the samples it has; of interleaved lines only the
    wanted bands' bytes are read."""
    if header["data_type"] not in TYPES:
        raise ValueError(f"{path}: data type {header['data_type']} is not supported")
    kind = np.dtype(TYPES[header["data_type"]])
    n_l, n_s, n_b = header["lines"], header["samples"], header["bands"]
    picked = list(range(n_b)) if bands is None else list(bands)
    if any(not 0 <= b < n_b for b in picked):
        raise ValueError(f"{path}: it has bands 0 to {n_b - 1}, asked for {picked}")
    with opened(path) as f:
        if f.size() != n_l * n_b * n_s * kind.itemsize:
            raise ValueError(f"{path}: file has {f.size()} bytes, not what its header says")

        def values(offset: int, n: int) -> np.ndarray:
            return np.frombuffer(take(f, offset * kind.itemsize, n * kind.itemsize), kind)

        for line in range(start, start + count):
            n = header.get("last_samples", n_s) if line == n_l - 1 else n_s
            if header["interleave"] == "bip":
                yield line, values(line * n_s * n_b, n * n_b).reshape(n, n_b)[:, picked]
            elif header["interleave"] == "bsq":
                yield line, np.stack([values((b * n_l + line) * n_s, n) for b in picked], axis=1)
            elif len(picked) < n_b or n < n_s:
                yield line, np.stack([values((line * n_b + b) * n_s, n) for b in picked], axis=1)
            else:
                yield line, values(line * n_s * n_b, n_s * n_b).reshape(n_b, n_s).T


def existing(paths: list[str]) -> list[str]:
    from pyarrow import fs

    if not paths:
        return []
    system, _ = file_system(paths[0])
    found = system.get_file_info([file_system(p)[1] for p in paths])
    return [p for p, f in zip(paths, found, strict=True) if f.type != fs.FileType.NotFound]


def move(source: str, target: str) -> None:
    system, name = file_system(target)
    system.create_dir(name.rpartition("/")[0], recursive=True)
    system.move(file_system(source)[1], name)


def remove_folder(folder: str) -> None:
    """The folder with all in it; and the one above, if that leaves it empty."""
    from pyarrow import fs

    system, name = file_system(folder)
    if system.get_file_info(name).type != fs.FileType.NotFound:
        system.delete_dir(name)
    above = name.rpartition("/")[0]
    if system.get_file_info(above).type == fs.FileType.Directory and not system.get_file_info(fs.FileSelector(above)):
        system.delete_dir(above)


class CubeFiles:
    """Cubes written line after line below an attempt's folder; ``moves`` tells where the finished files belong."""

    def __init__(self, attempt: str, root: str, data_type: int, header: dict) -> None:
        self.attempt, self.root, self.data_type, self.extra = attempt, root, data_type, header
        self.moves: list[tuple[str, str]] = []
        self.folder: str | None = None
        self.file = None

    def __enter__(self) -> CubeFiles:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is None:
            self._finish()
        elif self.file is not None:
            self.file.close()

    def _target(self, name: str) -> str:
        path = f"{self.attempt}/{self.folder}/{name}"
        self.moves.append((path, f"{self.root}/{self.folder}/{name}"))
        return path

    def _put(self, name: str, content: str) -> None:
        system, path = file_system(self._target(name))
        with system.open_output_stream(path) as f:
            f.write(content.encode())

    def _start(self, folder: str, line: int, samples: int, bands: int) -> None:
        self.folder, self.first, self.lines, self.samples, self.bands, self.peak, self.side = folder, line, 0, samples, bands, 0, defaultdict(str)
        self.last: int | None = None  # samples of a line that was cut off, after which none may follow
        system, path = file_system(f"{self.attempt}/{folder}")
        system.create_dir(path, recursive=True)
        self.file = system.open_output_stream(file_system(self._target("frame.bil"))[1])

    def _finish(self) -> None:
        if self.file is None:
            return
        self.file.close()
        self.file = None
        peak = int(self.peak) if float(self.peak).is_integer() else self.peak
        rows = {"interleave": "bil", "data type": self.data_type, "lines": self.lines, "samples": self.samples, "bands": self.bands, "ceiling": peak, **self.extra}
        rows |= {} if self.last is None else {LAST_SAMPLES: self.last}
        for name, content in self.side.items():
            self._put(name, content)
        self._put("frame.bil.hdr", "ENVI\n" + "".join(f"{k} = {v}\n" for k, v in rows.items()))

    def add(self, folder: str, line: int, samples: int, bands: int, data: bytes, peak: float, side, width: int | None = None) -> None:
        """The next line; ``side`` holds text to add to files beside the cube, by name. ``width``: samples of a whole line, if
        this one was cut off; only a cube's last may be."""
        whole = samples if width is None else width
        if folder != self.folder:
            self._finish()
            self._start(folder, line, whole, bands)
        if line != self.first + self.lines or (whole, bands) != (self.samples, self.bands) or self.last is not None or not 0 < samples <= whole:
            raise ValueError(f"{folder}: pixels are missing or repeated at line {line}")
        size = np.dtype(TYPES[self.data_type]).itemsize
        if len(data) != samples * bands * size:
            raise ValueError(f"{folder}: line {line} has {len(data)} bytes")
        if samples < whole:
            self.last = samples
            data = np.pad(np.frombuffer(data, "u1").reshape(bands, samples * size), ((0, 0), (0, (whole - samples) * size))).tobytes()
        self.file.write(data)
        self.lines += 1
        self.peak = max(self.peak, peak or 0)
        for name, content in dict(side or {}).items():
            self.side[name] += content
