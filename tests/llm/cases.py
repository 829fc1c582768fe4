"""A small documents table with the awkward cases every operator has to take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, language string, fp long"
LONG = " ".join(f"word{i % 997} and{i}" for i in range(30_000))
ENGLISH = "The thing that was of the other kind and for this with it. "
FRENCH = "Le chat est sur la table et les enfants sont dans la maison. "
GERMAN = "Der Hund ist nicht auf dem Tisch und die Kinder sind im Haus. "
SPANISH = "El gato no es para los que viven en la casa de las flores. "


def rows() -> list[tuple]:
    out = []
    for i in range(60):
        base = (ENGLISH, FRENCH, GERMAN, SPANISH)[i % 4]
        lang = ("en", "fr", "de", "es")[i % 4]
        out.append((i, "\n".join(base + f"Number {i * 7 + j} of {i}." for j in range(1 + i % 5)), lang, "src0" if i % 3 == 0 else f"src{i % 7}"))
    out += [
        (60, "", "en", "src1"), (61, None, "en", "src1"), (62, "   \n\t ", None, "src2"), (63, LONG, "en", "src0"),
        (64, LONG, "en", "src0"), (65, out[4][1], "en", None), (66, out[4][1] + " extra", "en", "src4"), (66, out[4][1] + " extra", "en", "src4"),
        (None, "A text without an id.", "en", "src1"), (None, None, None, None), (67, "a", "en", "src1"), (68, "ÄÖ ß İ ﬁ 漢字 é  x y", "de", "src2"),
        (69, "says <|endoftext|> and don't, it's 12", "en", "src3"), (70, "12345 !!! ***", "en", "src3"), (71, "A\x00B\x1cC\x85D", "en", "src3"),
    ]
    return [(*r, len(r[1] or ""), 0.25, "clash", 7) for r in out]


def documents(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def labels(spark: SparkSession) -> DataFrame:
    marked = [(i, int(i % 6 != 0), 0) for i in range(60)] + [(None, 1, 0), (61, None, 0), (60, 0, 0), (5, 1, 1)]
    return spark.createDataFrame(marked, "doc_id long, quality int, toxic int")


def write(spark: SparkSession, folder) -> str:
    documents(spark).write.parquet(f"{folder}/documents.parquet")
    labels(spark).write.parquet(f"{folder}/labels.parquet")
    return str(folder)
