"""Row types of the files and tables that the operators exchange."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BooleanType, DoubleType, FloatType, IntegerType, LongType, StringType, StructField, StructType


def _of(**cols) -> StructType:
    return StructType([StructField(k, v, True) for k, v in cols.items()])


D, I, L, S = DoubleType(), IntegerType(), LongType(), StringType()  # noqa: E741

#: One grey image per row; pixels by rows, x fastest.
FRAMES = _of(frame=L, h=I, w=I, px=ArrayType(DoubleType(), False))
#: One non-zero of a complex volume per row.
VOXELS = _of(frame=L, z=I, y=I, x=I, re=D, im=D)
VOXEL_FILE = _of(x=I, y=I, z=I, value=D)
#: A complex plane of a volume per row, by rows.
PLANES = _of(frame=L, z_idx=I, z=D, h=I, w=I, re=ArrayType(DoubleType(), False), im=ArrayType(DoubleType(), False))
CENTROID_FILE = _of(x=D, y=D, z=D, n=I)
CENTROID_VERBOSE_FILE = _of(x=D, y=D, z=D, wx=D, wy=D, wz=D, n=I, vmax=D, vmean=D, xmin=I, xmax=I, ymin=I, ymax=I, zmin=I, zmax=I)
CENTROIDS = _of(frame=L, x=D, y=D, z=D, size=D)
TRACKS = _of(x=D, y=D, z=D, frame=D, ID=I)
POINTS_2D = _of(time=FloatType(), x=FloatType(), y=FloatType(), size=FloatType())
FOCUS = _of(z_idx=I, raw_real=D, raw_imag=D)
HISTOGRAM = _of(begin=D, end=D, count=L)
SOLVER_METRICS = _of(it=I, f=D, sparsity=D, stepsize=D, total_backtracks=I)
BACKGROUND_STATS = _of(alpha=D, beta=D, minimum=D, average=D)
PLANE_COUNTS = _of(plane=I, nnz=L)
CODED_PARAMETER = _of(name=S, code=I, value=S)
FLAG = BooleanType()

VOXEL_HEADER = "x, y, z, value"
CENTROID_HEADER = "x (pixels), y (pixels), z (planes), # of voxels"
TRACK_HEADER = "x,y,z,frame,ID"
