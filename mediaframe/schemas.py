"""Fixed values and schemas shared by the operators."""

from __future__ import annotations

from pyspark.sql import types as T

# Macroblock type bits.
INTRA4X4 = 1 << 0
INTRA16X16 = 1 << 1
INTRA_PCM = 1 << 2
T16X16 = 1 << 3
T16X8 = 1 << 4
T8X16 = 1 << 5
T8X8 = 1 << 6
LIST1 = (1 << 14) | (1 << 15)
SKIP = 1 << 17
DCT8X8 = 1 << 24
INTRA_ANY = INTRA4X4 | INTRA16X16 | INTRA_PCM

# Slice kinds.
SLICE_I, SLICE_P, SLICE_B = 1, 2, 3

# Position of the 16 luma blocks in the padded 8-wide neighbour grid, in z-order.
GRID_INDEX = [12, 13, 20, 21, 14, 15, 22, 23, 28, 29, 36, 37, 30, 31, 38, 39]
# Row and column (in 4-pixel units) of the 16 luma blocks, in z-order.
LUMA_ROW = [0, 0, 1, 1, 0, 0, 1, 1, 2, 2, 3, 3, 2, 2, 3, 3]
LUMA_COL = [0, 1, 0, 1, 2, 3, 2, 3, 0, 1, 0, 1, 2, 3, 2, 3]
# Z-order luma block -> index of its value in the DC transform output.
LUMA_DC_FROM = [0, 4, 1, 5, 8, 12, 9, 13, 2, 6, 3, 7, 10, 14, 11, 15]
# Fixed value: "neighbour not available" marker in coefficient counts.
NNZ_UNAVAILABLE = 64
# Packing width, block caps and tracked-list cap.
PACK_WIDTH = 4096
BATCH_BLOCKS = 960
DC_BATCH_BLOCKS = 256
QUEUE_MAX = 1024
TRACK_MAX = 4096
REFERENCE_MAX = 32

BOX = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("box_id", T.IntegerType()),
        T.StructField("parent_id", T.IntegerType()),
        T.StructField("depth", T.IntegerType()),
        T.StructField("parent_type", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("off", T.LongType()),
        T.StructField("hdr", T.IntegerType()),
        T.StructField("size", T.LongType()),
    ]
)

TRACK = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("track_id", T.IntegerType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("nal_length_size", T.IntegerType()),
        T.StructField("sps", T.BinaryType()),
        T.StructField("pps", T.BinaryType()),
        T.StructField("sample_count", T.LongType()),
        T.StructField("const_size", T.LongType()),
        T.StructField("sizes", T.ArrayType(T.LongType())),
        T.StructField("chunk_offsets", T.ArrayType(T.LongType())),
        T.StructField("first_chunk", T.ArrayType(T.LongType())),
        T.StructField("samples_per_chunk", T.ArrayType(T.LongType())),
    ]
)

NAL = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("track_id", T.IntegerType()),
        T.StructField("sample_idx", T.LongType()),
        T.StructField("nal_idx", T.IntegerType()),
        T.StructField("off", T.LongType()),
        T.StructField("len", T.LongType()),
        T.StructField("nal_type", T.IntegerType()),
        T.StructField("bad_tail", T.BooleanType()),
    ]
)

PIXEL = T.StructType(
    [
        T.StructField("frame", T.LongType()),
        T.StructField("plane", T.IntegerType()),
        T.StructField("y", T.IntegerType()),
        T.StructField("x", T.IntegerType()),
        T.StructField("v", T.IntegerType()),
    ]
)

MB_INFO = T.StructType(
    [
        T.StructField("file_id", T.LongType()),
        T.StructField("decode_no", T.LongType()),
        T.StructField("mb_x", T.IntegerType()),
        T.StructField("mb_y", T.IntegerType()),
        T.StructField("mb_type", T.IntegerType()),
        T.StructField("qscale", T.IntegerType()),
        T.StructField("coeffs", T.ArrayType(T.ShortType())),
        T.StructField("nnz", T.ArrayType(T.ShortType())),
        T.StructField("mv_l0", T.ArrayType(T.ShortType())),
        T.StructField("ref_l0", T.ArrayType(T.ByteType())),
        T.StructField("luma_dc", T.ArrayType(T.ShortType())),
        T.StructField("luma_dc_qmul", T.IntegerType()),
        T.StructField("intra16x16_pred_mode", T.IntegerType()),
        T.StructField("chroma_pred_mode", T.IntegerType()),
        T.StructField("chroma_dc_qmul", T.ArrayType(T.IntegerType())),
        T.StructField("cbp", T.IntegerType()),
        T.StructField("mb_width", T.IntegerType()),
        T.StructField("mb_height", T.IntegerType()),
        T.StructField("slice_type", T.IntegerType()),
        T.StructField("sub_mb_type", T.ArrayType(T.IntegerType())),
        T.StructField("has_ref", T.BooleanType()),
    ]
)

EDGE = T.StructType(
    [
        T.StructField("alpha", T.IntegerType()),
        T.StructField("beta", T.IntegerType()),
        T.StructField("tc0", T.ArrayType(T.IntegerType())),
        T.StructField("window", T.ArrayType(T.ArrayType(T.IntegerType()))),
    ]
)
