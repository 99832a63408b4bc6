"""Packet recovery on a stream: the state of a sender lives from batch to batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "stream_id bigint, pos bigint, frame_index bigint, status string"
STATE = "expected bigint, holds boolean"


def classify(packets: DataFrame) -> DataFrame:
    """status of every packet of a stream of (stream_id, pos, frame_index, key, crc_bad, dec_bad).

    Packets of one sender must arrive in order between batches; inside a batch
    they are sorted.  State is the index expected next and whether the
    references are sound.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        expected, holds = state.get if state.exists else (0, False)
        rows = []
        pdf = pd.concat(list(batches)).sort_values("pos")
        for pos, index, is_key, crc_bad, dec_bad in zip(*(pdf[c].tolist() for c in ("pos", "frame_index", "key", "crc_bad", "dec_bad")), strict=True):
            gap = index != expected
            holds = holds and not gap
            if crc_bad:
                status = "corrupt"
            elif is_key:
                status = "corrupt" if dec_bad else "shown" if not gap else "recovered_gap" if expected else "recovered_leading_loss"
            elif not holds:
                status = "dependency_lost"
            else:
                status = "corrupt" if dec_bad else "shown"
            holds = status not in ("corrupt", "dependency_lost")
            expected = index + 1
            rows.append((key[0], pos, index, status))
        state.update((expected, holds))
        yield pd.DataFrame(rows, columns=["stream_id", "pos", "frame_index", "status"])

    return packets.groupBy("stream_id").applyInPandasWithState(step, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
