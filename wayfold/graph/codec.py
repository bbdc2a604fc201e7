"""Binary road graphs: one blob per graph or cell, encoded and decoded in Arrow batches.

Layout, little-endian: magic, version, node count, edge count, geometry count, blob size, name count (32 bits each); nodes (lat, lon); offsets of each
node's edges; edges (target, speed << 24 | dist, geometry, name, class and access), 2^32 - 1 for no geometry; geometry offsets; geometry
blob; name offsets; names.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np

from ..functions.codecs import pack_line, unpack_line

MAGIC, VERSION, NONE = b"WFRG", 4, 0xFFFFFFFF


@dataclass
class Graph:
    nodes: np.ndarray  # (n, 2) int32: lat_e7, lon_e7
    edges: np.ndarray  # (m, 6) int64: src, dst, speed, dist_dm, geometry or -1, name
    access: np.ndarray  # (m,) uint32
    lines: list[list[tuple[int, int]]] = field(default_factory=list)
    names: list[str] = field(default_factory=lambda: [""])


def encode(g: Graph) -> bytes:
    order = np.argsort(g.edges[:, 0], kind="stable") if len(g.edges) else np.empty(0, int)
    e, n = g.edges[order], len(g.nodes)
    offsets = np.concatenate([[0], np.cumsum(np.bincount(e[:, 0], minlength=n))]) if n else np.zeros(1)
    packed = np.stack([e[:, 1], (e[:, 2] & 255) << 24 | np.minimum(e[:, 3], 0xFFFFFF), np.where(e[:, 4] < 0, NONE, e[:, 4]), e[:, 5], g.access[order]], axis=1)
    blobs, names = [pack_line(x) for x in g.lines], [x.encode() for x in g.names]
    ends = lambda parts: np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype("<u4").tobytes()
    head = struct.pack("<4s6I", MAGIC, VERSION, n, len(e), len(blobs), sum(map(len, blobs)), len(names))
    return b"".join([head, g.nodes.astype("<i4").tobytes(), offsets.astype("<u4").tobytes(), packed.astype("<u4").tobytes(), ends(blobs), *blobs, ends(names), *names])


def decode(blob: bytes) -> Graph:
    magic, version, n, m, k, size, names = struct.unpack_from("<4s6I", blob)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a graph of this version")
    at = 28

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(blob, kind, count, at)
        at += out.nbytes
        return out

    nodes, offsets, packed = take("<i4", 2 * n).reshape(-1, 2), take("<u4", n + 1), take("<u4", 5 * m).reshape(-1, 5).astype(np.int64)
    src = np.repeat(np.arange(n), np.diff(offsets.astype(np.int64)))
    ends = take("<u4", k + 1)
    lines = [unpack_line(blob[at + a : at + b]) for a, b in zip(ends, ends[1:])]
    at += size
    ends = take("<u4", names + 1)
    words = [blob[at + a : at + b].decode() for a, b in zip(ends, ends[1:])]
    edges = np.stack([src, packed[:, 0], packed[:, 1] >> 24, packed[:, 1] & 0xFFFFFF, np.where(packed[:, 2] == NONE, -1, packed[:, 2]), packed[:, 3]], axis=1)
    return Graph(nodes, edges, packed[:, 4].astype(np.uint32), lines, words)
