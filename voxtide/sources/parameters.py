"""Parameter files: lines of a name, a numeric code and a value, where the code says which setting the value is for.

A line that starts with % or # is a comment, and empty lines count for nothing. The name is for the reader. A number is
what the value starts with, so a remark may follow it; a text goes up to a tab or the line's end (file patterns hold %
and blanks); a flag is `true`, `false` or a number. Of lines with one code the last counts.

`read_parameters` gives a row per line. In PERMISSIVE mode a line that isn't right (no code, a code that isn't known, a
value of another kind) has the reason in column `broken`, and no value; in FAILFAST mode it is an error. Files are read
by Spark, one row each, cut into lines in place; they are the size of a page, and their number may grow.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import Settings
from ..functions.arrays import let


@dataclass(frozen=True)
class Parameter:
    code: int
    name: str
    kind: str  # whole, number, text or flag
    setting: str  # where `Settings` has it, or '' for those that go to `Settings.other` by name


# Codes as parameter files have them.
CODES = (
    Parameter(1001, "NUM_IMAGES", "whole", "count"),
    Parameter(1002, "START_IMAGE", "whole", "start"),
    Parameter(1003, "BG_START", "whole", "background_start"),
    Parameter(1004, "BG_END", "whole", "background_stop"),
    Parameter(2001, "INPUT_FN", "text", "image_pattern"),
    Parameter(2002, "INPUT_PATHN", "text", ""),
    Parameter(2003, "INPUT_FORMATFN", "text", ""),
    Parameter(2004, "OUTPUT_PATHN", "text", "output"),
    Parameter(2005, "INPUT_BACKGROUND", "text", ""),
    Parameter(2006, "EXE_PATHN", "text", ""),
    Parameter(3001, "START_PLANE", "number", "optics.z0"),
    Parameter(3002, "PLANE_STEP", "number", "optics.dz"),
    Parameter(3003, "NUM_PLANES", "whole", "optics.planes"),
    Parameter(3004, "WAVELENGTH", "number", "optics.wavelength"),
    Parameter(3005, "RESOLUTION", "number", "optics.resolution"),
    Parameter(3006, "ROI_X", "number", ""),
    Parameter(3007, "ROI_Y", "number", ""),
    Parameter(3008, "ROI_Z", "number", ""),
    Parameter(3009, "ROI_SIZE", "number", ""),
    Parameter(3010, "ZERO_PADDING", "whole", "optics.zero_pad"),
    Parameter(3011, "ROI_RECT_X", "number", ""),
    Parameter(3012, "ROI_RECT_Y", "number", ""),
    Parameter(3013, "ROI_RECT_W", "number", ""),
    Parameter(3014, "ROI_RECT_H", "number", ""),
    Parameter(4001, "BETA", "number", ""),
    Parameter(4002, "IIPE_ITERATIONS", "whole", ""),
    Parameter(5001, "PARTICLE_DIAMETER", "number", ""),
    Parameter(5002, "CHAMBER_RADIUS", "number", ""),
    Parameter(5003, "PARTICLE_CONCENTRATION", "number", ""),
    Parameter(5004, "PARTICLE_LENGTH", "number", ""),
    Parameter(5005, "PARTICLE_RESOLUTION", "number", ""),
    Parameter(5006, "IMAGE_SIZE", "whole", ""),
    Parameter(5007, "ROTATION_STEP", "number", ""),
    Parameter(5008, "OVERSAMPLE", "number", ""),
    Parameter(5009, "SEGMENT_MIN_AREA", "whole", "segmentation.min_voxels"),
    Parameter(5010, "SEGMENT_MIN_INTENSITY", "number", "segmentation.min_intensity"),
    Parameter(5011, "SEGMENT_CLOSE_SIZE", "number", "segmentation.close_size"),
    Parameter(6001, "NUM_INVERSE_ITS", "whole", "solver.outer"),
    Parameter(6002, "INVERSE_REG_TAU", "number", "solver.l1"),
    Parameter(6003, "INVERSE_MAX_SVD", "number", ""),
    Parameter(6004, "INVERSE_REG_TV", "number", "solver.tv"),
    Parameter(6005, "NUM_TV_ITS", "whole", "solver.inner"),
    Parameter(7001, "OUTPUT_PLANES", "flag", ""),
    Parameter(7002, "STANDARD_RECON", "flag", ""),
    Parameter(7003, "INVERSE_RECON", "flag", ""),
    Parameter(7004, "DECONV_RECON", "flag", ""),
    Parameter(7005, "OUTPUT_STEPS", "flag", ""),
    Parameter(7006, "MEDIAN_BACKGROUND", "flag", ""),
)

LINE = r"^\s*(\S+)\s+(-?\d+)\s+([^\t]*[^\t\s])"
NUMBER = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"
#: Settings that are lengths, which `unit` scales.
LENGTHS = ("optics.z0", "optics.dz", "optics.wavelength", "optics.resolution")


def registry(spark: SparkSession) -> DataFrame:
    """(code, setting_name, kind): a row per code."""
    return spark.createDataFrame([(p.code, p.name, p.kind) for p in CODES], "code int, setting_name string, kind string")


def parse_lines(lines: DataFrame, mode: str = "PERMISSIVE") -> DataFrame:
    """`lines` (with `value`, and no column of a name given here) as (its other columns, name, code, setting_name, kind, number, text, flag, broken); comments and empty lines are left out."""
    if mode not in ("PERMISSIVE", "FAILFAST"):
        raise ValueError(f"mode is PERMISSIVE or FAILFAST, not {mode}")
    rows = lines.filter((F.trim("value") != "") & ~F.col("value").startswith("%") & ~F.col("value").startswith("#"))
    part = lambda i: F.regexp_extract("value", LINE, i)
    rows = rows.withColumns({"name": F.nullif(part(1), F.lit("")), "code": part(2).try_cast("int"), "said": F.nullif(part(3), F.lit(""))})
    known = rows.join(F.broadcast(registry(lines.sparkSession)), "code", "left")
    number = F.regexp_extract("said", NUMBER, 0).try_cast("double")
    flag = F.when(F.trim("said") == "true", True).when(F.trim("said") == "false", False).otherwise(number != 0)
    kind = F.col("kind")
    value = {
        "number": F.when(kind.isin("number", "whole"), number),
        "text": F.when(kind == "text", F.col("said")),
        "flag": F.when(kind == "flag", flag),
    }
    known = known.withColumns(value)
    wrong = (
        F.when(F.col("name").isNull(), "not a name, a code and a value")
        .when(kind.isNull(), "no such code")
        .when(kind.isin("number", "whole") & F.col("number").isNull(), "not a number")
        .when((kind == "whole") & (F.col("number") != F.floor("number")), "not a whole number")
        .when((kind == "flag") & F.col("flag").isNull(), "not a flag")
    )
    broken = wrong if mode == "PERMISSIVE" else F.when(wrong.isNotNull(), F.raise_error(F.concat(wrong, F.lit(": "), "value"))).otherwise(F.lit(None).cast("string"))
    known = known.withColumn("broken", broken)
    blank = {c: F.when(F.col("broken").isNull(), F.col(c)) for c in ("number", "text", "flag")}
    return known.withColumns(blank).select(*[c for c in lines.columns if c != "value"], "name", "code", "setting_name", "kind", "number", "text", "flag", "broken")


def read_parameters(spark: SparkSession, path: str, mode: str = "PERMISSIVE") -> DataFrame:
    """(path, line, name, code, setting_name, kind, number, text, flag, broken): a row per line of the files of a path, lines numbered from 1."""
    files = spark.read.text(path, wholetext=True).select("value", F.input_file_name().alias("path"))
    cut = files.select("path", F.posexplode(F.split("value", r"\r\n?|\n")).alias("line", "value"))
    return parse_lines(cut.withColumn("line", F.col("line") + 1), mode)


def effective(rows: DataFrame) -> DataFrame:
    """Of a file's right lines with one code, the last."""
    last = Window.partitionBy("path", "code").orderBy(F.desc("line"))
    return rows.filter("broken is null").withColumn("__r", F.row_number().over(last)).filter("__r = 1").drop("__r")


def _value(p: Parameter, row) -> object:
    return {"text": row["text"], "flag": row["flag"], "number": row["number"], "whole": None if row["number"] is None else int(row["number"])}[p.kind]


def load_settings(spark: SparkSession, path: str, mode: str = "FAILFAST", unit: float = 1.0, base: Settings | None = None) -> Settings:
    """`base` (default settings) with what a file says; `unit` is how many micrometres its unit of length has.

    Without INPUT_FN the image pattern is INPUT_PATHN and INPUT_FORMATFN joined. A row per known code comes to the driver.
    """
    by_code = {p.code: p for p in CODES}
    rows = {r["code"]: _value(by_code[r["code"]], r) for r in effective(read_parameters(spark, path, mode)).collect()}
    settings = base or Settings()
    other, parts, top = dict(settings.other), {}, {}
    for code, value in rows.items():
        p = by_code[code]
        if p.setting in LENGTHS:
            value *= unit
        if "." in p.setting:
            group, _, key = p.setting.partition(".")
            parts.setdefault(group, {})[key] = value
        elif p.setting and p.setting != "count":
            top[p.setting] = value
        elif not p.setting:
            other[p.name] = value
    start = top.get("start", settings.start)
    if 1001 in rows:
        top["stop"] = start + rows[1001] - 1
    if 2001 not in rows and (2002 in rows or 2003 in rows):
        top["image_pattern"] = f"{rows.get(2002, '')}{rows.get(2003, '')}"
    made = {g: replace(getattr(settings, g), **v) for g, v in parts.items()}
    return replace(settings, other=other, **top, **made)


def parameter_lines(settings: Settings, unit: float = 1.0) -> list[str]:
    """A line per setting that a file can say, in the order of codes; `load_settings` of them gives the settings back."""
    out = []
    for p in CODES:
        if p.setting == "count":
            value: object = settings.stop - settings.start + 1
        elif "." in p.setting:
            group, _, key = p.setting.partition(".")
            value = getattr(getattr(settings, group), key)
        else:
            value = getattr(settings, p.setting) if p.setting else settings.other.get(p.name)
        if value is None or value == "":
            continue
        if p.setting in LENGTHS:
            value /= unit
        said = str(value).lower() if p.kind == "flag" else str(int(value)) if p.kind == "whole" else repr(float(value)) if p.kind == "number" else value
        out.append(f"{p.name} {p.code} {said}")
    return out


def write_parameters(spark: SparkSession, settings: Settings, path: str, unit: float = 1.0) -> None:
    """As one text file in a folder."""
    spark.createDataFrame([("\n".join(parameter_lines(settings, unit)),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def settings_columns(rows: DataFrame, *names: str) -> DataFrame:
    """(path, a column per name): what each of many files says, numbers as double, flags and texts as text."""
    said: Column = F.coalesce(F.col("text"), F.col("flag").cast("string"), F.col("number").cast("string"))
    return effective(rows).groupBy("path").agg(*[let(F.collect_list(F.when(F.col("setting_name") == n, said)), lambda a: F.get(a, F.lit(0))).alias(n) for n in names])
