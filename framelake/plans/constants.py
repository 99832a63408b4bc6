"""Values of the stream format, as text or by the rule that gives them.

The tables here must equal the format's for right results; those over a few
hundred entries are computed from their rule.
"""

from __future__ import annotations

import math
from functools import cache

# The declared limits.
SUPERBLOCK, CELL = 64, 8
QP_MAX, LEVEL_MAX = 63, 32767
WIDTHS, HEIGHTS = (64, 4096), (64, 2304)
PAYLOAD_BYTES = (5, 16_777_216)
HEADER_BYTES = 24
CONTEXTS, RESERVED_CONTEXTS = 144, 28
PROBABILITY_TOTAL, ADAPTATION_SHIFT = 4096, 5
KEY_INTERVAL, GOLDEN_INTERVAL = 120, 16
SCENE_HISTORY, SCENE_HISTORY_LEAST, SCENE_FACTOR = 16, 4, 3
RATE_WINDOW, BUCKET_MULTIPLE, QP_STEP, EWMA_SHIFT = 8, 2, 2, 3
MV_LIMIT_Q4 = 64 << 2
FILTER_TAPS = (1, -5, 20, 20, -5, 1)
ABR_TOLERANCE_PERCENT = 5.0
BD_ALLOWANCE_PERCENT = 2.0
ANGLES = {"d45": 32, "d135": -32, "d117": -21, "d153": -11}
INTRA_MODES = ("dc", "planar", "horizontal", "vertical", "d45", "d135", "d117", "d153")
GAUSSIAN_SIGMA, GAUSSIAN_RADIUS = 1.5, 5
SSIM_C1, SSIM_C2 = (0.01 * 255.0) ** 2, (0.03 * 255.0) ** 2

BLOCK_SIZES, TRANSFORM_SIZES = (64, 32, 16, 8), (32, 16, 8, 4)
REFERENCES = ("last", "golden")
UNAVAILABLE_SAMPLE = 128
EDGE_EXTENSION, LEAST_EDGE = 64, 8

# Offsets that motion search visits, in order, and its steps below a pixel (quarter pixels).
FULL_PATTERN = ((0, -1), (-1, 0), (1, 0), (0, 1))
SUB_PATTERN = ((0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1))
SUB_STEPS = (2, 1)
# Encoder settings by name, and the tool that each goes without.
TOOLSETS = {"full": None, "no-golden": "golden", "no-skip": "skip", "no-inter": "inter", "no-subpel": "subpel", "no-split": "split"}

# First context of each syntax element's group, and the elements in the order of their inventory.
CONTEXT_OF = {"partition_tree": 0, "skip": 12, "is_inter": 15, "intra_mode": 18, "ref_select": 28, "mvd": 30, "has_coeff": 36, "last_x": 44, "last_y": 60, "sig": 76, "gt1": 120, "gt2": 136}
ELEMENTS = ("partition_tree", "skip", "is_inter", "intra_mode", "ref_select", "mvd", "has_coeff", "last_x", "last_y", "sig", "gt1", "gt2", "magnitude_remainder", "nonzero_sign")

# Quantizer scale of each QP.
QSCALE = [16, 18, 20, 23, 25, 29, 32, 36, 40, 45, 51, 57, 64, 72, 81, 91, 102, 114, 128, 144, 161, 181, 203, 228, 256, 287, 323, 362, 406, 456, 512, 575, 645, 724, 813, 912, 1024, 1149, 1290, 1448, 1625, 1825, 2048, 2299, 2580, 2896, 3251, 3649, 4096, 4598, 5161, 5793, 6502, 7298, 8192, 9195, 10321, 11585, 13004, 14596, 16384, 18390, 20643, 23170]
# Rate weight of each QP, in 1/256.
LAMBDA_Q8 = [9, 11, 14, 18, 23, 29, 36, 46, 58, 73, 92, 116, 146, 184, 232, 292, 368, 463, 584, 735, 927, 1167, 1471, 1853, 2335, 2942, 3706, 4669, 5883, 7412, 9339, 11766, 14825, 18678, 23533, 29649, 37356, 47065, 59298, 74711, 94130, 118596, 149422, 188260, 237193, 298844, 376520, 474386, 597688, 753040, 948771, 1195377, 1506080, 1897542, 2390753, 3012160, 3795084, 4781507, 6024321, 7590169, 9563013, 12048642, 15180337, 19126026]
# Loop-filter thresholds of each QP; alpha rises by 2 from QP 9, beta by 1 every second QP from 14.
ALPHA = [0] * 9 + [2 * (q - 8) for q in range(9, 64)]
BETA = [0] * 14 + [(q - 12) // 2 for q in range(14, 64)]
TC = [max(1, 1 + (q - 1) // 8) for q in range(64)]
# Loop-filter strength by edge kind, intra neighbour, coded neighbour.
STRENGTH = [
    ("derived_transform", False, False, 0), ("coding_block", False, False, 1), ("derived_transform", False, True, 1),
    ("coding_block", False, True, 1), ("coding_block", True, False, 2), ("coding_block", True, True, 2),
]


@cache
def dct_matrix(n: int) -> list[list[int]]:
    """Row k: 64 for k = 0, else round(64 sqrt(2) cos(pi (2x + 1) k / 2n))."""
    return [[64 if k == 0 else round(64 * math.sqrt(2) * math.cos(math.pi * (2 * x + 1) * k / (2 * n))) for x in range(n)] for k in range(n)]


@cache
def diagonal_scan(n: int) -> list[tuple[int, int]]:
    """(x, y) in scan order: diagonals from the origin, direction alternating."""
    out: list[tuple[int, int]] = []
    for d in range(2 * n - 1):
        line = [(x, d - x) for x in range(n) if 0 <= d - x < n]
        out += line[::-1] if d % 2 else line
    return out


@cache
def bin_cost_q16(p1: int, symbol: int) -> int:
    """-log2 of the symbol's probability in 1/65536 bits; ``p1`` is out of 4096."""
    p = p1 if symbol else PROBABILITY_TOTAL - p1
    return math.floor(-math.log2(p / PROBABILITY_TOTAL) * 65536 + 0.5)


def gaussian() -> list[float]:
    """11 taps, normalised."""
    raw = [math.exp(-((i - GAUSSIAN_RADIUS) ** 2) / (2 * GAUSSIAN_SIGMA**2)) for i in range(2 * GAUSSIAN_RADIUS + 1)]
    return [x / sum(raw) for x in raw]


def first_qp(budget_bits: int) -> int:
    """First QP of a stream: 63, less 2 for every doubling of a frame's bits."""
    return max(1, 63 - 2 * min(31, budget_bits.bit_length() - 1)) if budget_bits > 0 else 63
