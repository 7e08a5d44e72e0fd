"""Candidates of the near-duplicate stage are discarded by their coordinates and verified bit by bit."""

from voxtide.llm import similar
from voxtide.llm.simhash import segment_distances, segments


def test_pairs_that_agree(spark):
    a = 0x0123456789ABCDEF
    rows = [(a, a), (a, a ^ 1), (a, a ^ (1 << 40)), (-1, 0), (-5, -5)]
    got = similar.agreeing(spark.createDataFrame(rows, "fa long, fb long"), "fa", "fb").collect()
    assert {tuple(r) for r in got} == {(a, a), (-5, -5)}


def test_the_stage_discards_candidates(spark, monkeypatch):
    """With no segment to agree in, all nodes are candidates; those of other fingerprints are discarded, however similar."""
    text = " ".join(f"w{i}" for i in range(50))
    fps = [list(range(k, k + similar.SAMPLES)) for k in (0, 0, 1 << 20)]
    made = spark.createDataFrame([(bytes([k]), 46, f) for k, f in enumerate(fps)], "x binary, n long, fps array<long>")
    texts = spark.createDataFrame([(bytes([k]), text) for k in range(3)], "x binary, t string")
    monkeypatch.setattr(similar, "segment_distances", lambda fp, bits: segment_distances(fp, []))
    assert len(segments(similar.RADIUS)) == 2
    assert [(bytes(r["src"]), bytes(r["dst"])) for r in similar.links(made, texts).collect()] == [(b"\0", b"\1")]
