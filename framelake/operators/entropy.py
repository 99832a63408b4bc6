"""Range-coded payloads of blocks: one block is one payload, coded by a sequential kernel."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..functions import rangecoder as R

#: Context of the n-th decision of a code's prefix; later ones and all others have even odds.
PREFIX_CONTEXTS = 3


def encode_levels(levels: list[int]) -> tuple[bytes, int]:
    """Payload and modelled cost of a list of levels as signed order-0 codes with adaptive prefixes."""
    bins = []
    for v in levels:
        prefix = abs(v + (v >= 0) - (v < 0)).bit_length()
        for i, b in enumerate(R.exp_golomb_bins(v)):
            bins.append((b, i if i < min(prefix, PREFIX_CONTEXTS) else None))
    return R.encode(bins, [2048] * PREFIX_CONTEXTS)


def decode_levels(payload: bytes, n: int) -> list[int]:
    reader, contexts, out = R.Decoder(payload), [2048] * PREFIX_CONTEXTS, []
    for _ in range(n):
        at, more = 0, True

        def step() -> int:
            nonlocal at, more
            use = more and at < PREFIX_CONTEXTS
            bit = reader.context(contexts, at) if use else reader.bin(2048)
            at += 1
            more = more and bit == 1
            return bit

        out.append(R.read_exp_golomb(step))
    return out


def payloads(levels: DataFrame) -> DataFrame:
    """block_id, payload, cost_q16."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            coded = [encode_levels(list(x)) for x in b["level"]]
            yield pd.DataFrame({"block_id": b["block_id"], "payload": [c[0] for c in coded], "cost_q16": [c[1] for c in coded]})

    return levels.select("block_id", "level").mapInPandas(run, "block_id bigint, payload binary, cost_q16 bigint")


def roundtrip(levels: DataFrame) -> DataFrame:
    """block_id, same, n, bytes, cost_q16: whether every block's payload decodes to its levels."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, level in zip(b["block_id"].tolist(), b["level"].tolist(), strict=True):
                level = [int(x) for x in level]
                data, cost = encode_levels(level)
                rows.append((i, decode_levels(data, len(level)) == level, len(level), len(data), cost))
            yield pd.DataFrame(rows, columns=["block_id", "same", "n", "bytes", "cost_q16"])

    return levels.select("block_id", "level").mapInPandas(run, "block_id bigint, same boolean, n int, bytes int, cost_q16 bigint")
