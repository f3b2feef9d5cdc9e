import pytest
from pyspark.sql import functions as F

from stowage.functions import notes as N
from stowage.functions.codecs import smf

#: A scale in eighths, one long low note under it and a drum.
SCALE = [("s", 0.25 * k, 0.25 * k + 0.25, 62 + k, 50 + k, 4, False, 0) for k in range(8)]
ROWS = [*SCALE, ("s", 0.125, 5.5, 33, 77, 40, False, 1), ("s", 1.0, 1.125, 45, 111, 0, True, 2)]


@pytest.fixture
def notes(spark):
    return N.coerced(spark.createDataFrame(ROWS, "id string, onset double, offset double, pitch int, velocity int, program int, is_drum boolean, instrument int"))


def shown(df):
    return sorted((round(r.onset, 3), round(r.offset, 3), r.pitch, r.velocity) for r in df.collect())


def cut(start, end, partial=True):
    """What a window leaves of ROWS, note by note."""
    return sorted((max(a, start) - start, min(b, end) - start, pitch, velocity) for _, a, b, pitch, velocity, *_ in ROWS if b > start and a < end and (partial or a >= start))


def test_slices(notes):
    for start, end in ((0.6, 1.3), (0.0, 9.0), (5.5, 6.0), (1.0, 1.0)):
        for partial in (True, False):
            got = [(a, b, p, v) for a, b, p, v in shown(N.slice_notes(notes, start, end, partial))]
            assert got == [(round(a, 3), round(b, 3), p, v) for a, b, p, v in cut(start, end, partial)]
    assert len(cut(0.6, 1.3)) == 6 and len(cut(0.6, 1.3, False)) == 4
    for window in ((-0.5, 1), (2, 1)):
        with pytest.raises(ValueError):
            N.slice_notes(notes, *window)


def test_many_windows(spark, notes):
    windows = spark.createDataFrame([("s", 0.6, 1.3, "a"), ("s", 3.0, 4.0, "b"), ("t", 0.0, 9.0, "c")], "id string, start double, end double, w string")
    got = N.in_windows(notes, windows, "id")
    assert shown(got.where("w = 'a'")) == shown(N.slice_notes(notes, 0.6, 1.3)) and got.where("w = 'b'").count() == 1 and got.where("w = 'c'").count() == 0


def test_carry_in(spark):
    events = spark.createDataFrame([(11, 0.4, 0, 90), (11, 0.9, 1, 31), (11, 2.2, 2, 64), (1, 0.7, 3, 8), (1, 0.7, 4, 9), (5, 4.0, 5, 1)], "number int, time double, seq long, value int")
    got = sorted((r.number, round(r.time, 3), r.value) for r in N.controls_in_effect(events, 1.0, 3.0, "number").collect())
    assert got == [(1, 0.0, 9), (11, 0.0, 31), (11, 1.2, 64)]
    bends = events.withColumn("value", F.lit(0))
    assert N.controls_in_effect(bends, 1.0, 2.0, "number", drop_zero=True).count() == 0


def test_metadata_and_files(notes):
    row = N.metadata(notes, "id").first()
    assert (row.n_notes, row.programs, row.has_drums, row.min_pitch, row.max_pitch, row.duration) == (10, [4, 40], True, 33, 69, 5.5)
    midi = N.to_midi(notes, "id").first().midi
    assert shown(notes) == sorted((round(n["onset"], 3), round(n["offset"], 3), int(n["pitch"]), int(n["velocity"])) for n in smf.notes_of(smf.parse(bytes(midi))))


def test_coercion_and_order(spark, notes):
    few = N.coerced(spark.createDataFrame([(1.0, 2.0, 60)], "onset double, offset double, pitch long"))
    r = few.first()
    assert (r.velocity, r.program, r.is_drum, r.instrument) == (100, 0, False, 0)
    with pytest.raises(ValueError):
        N.coerced(spark.createDataFrame([(1.0,)], "onset double"))
    order = [r.pitch for r in N.canonical_sort(notes).collect()]
    assert order == [62, 33, 63, 64, 65, 66, 45, 67, 68, 69]
    assert [r.pitch for r in N.canonical_rank(notes, "id").orderBy("rank").collect()] == order
    assert N.tempo_at(spark.createDataFrame([("a", 1.0, 90.0), ("a", 3.0, 60.0), ("b", 5.0, 10.0)], "id string, time double, bpm double"), 3.5, "id").orderBy("id").collect()[1].tempo == 120.0
