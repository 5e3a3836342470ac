import hashlib
import zlib

from pyspark.sql import functions as F

from logsentinel.llm import media
from logsentinel.llm.queries import op8_of


def test_round_trip():
    for raw in (b"", b"a", b"x" * 63, b"x" * 64, b"x" * 65, bytes(range(256)) * 3):
        p = media.padded(raw)
        assert len(p) % 64 == 0 and len(p) >= 64 and p.startswith(raw) and media.decode(media.encode(p)) == p


def test_wave_module_reads_it():
    import io
    import wave

    p = media.padded(b"hello")
    with wave.open(io.BytesIO(media.encode(p))) as w:
        assert (w.getnchannels(), w.getsampwidth(), w.readframes(w.getnframes())) == (1, 1, p)


def test_sequence():
    got = media.sequence("<p>One <b>two</b></p><figure><img src='media:AB'><img src=\"media:cd\"><figcaption>A &amp; b</figcaption></figure>tail<script>no</script><img src='media:ef'/>")
    assert [(x["position"], x["kind"], x["text"], x["media"], x["caption"]) for x in got] == [
        (0, "text", "One two", None, None), (1, "media", None, "ab", "A & b"), (2, "media", None, "cd", "A & b"), (3, "text", "tail", None, None), (4, "media", None, "ef", None)]
    assert media.sequence(None) == media.sequence("<p></p>") == []


def test_query_and_resolve(spark):
    texts = {1: "héllo", 2: None, 3: "", 4: "a" * 64, 5: "héllo", None: "z" * 200_000}
    df = spark.createDataFrame([*texts.items(), (1, "héllo")], "doc_id long, text string").withColumn("media", F.lit(1))
    got = op8_of(df).collect()
    assert len(got) == 7
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        p = media.padded(raw)
        wav = media.encode(p)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert (r.position, r.caption) == (1, "" if r.doc_id is None else str(r.doc_id))
        assert (r.media_bytes, r.media_sha256, r.feature) == (len(wav), hashlib.sha256(wav).hexdigest(), media.features(p))
    assert op8_of(df.limit(0)).count() == 0
    html = spark.createDataFrame([(9, "<figure><img src='media:feed'><figcaption>c</figcaption></figure>")], "id long, html string")
    r = media.resolve(media.interleave(html, "id", "html"), media.store(df)).first()
    assert (r.id, r.position, r.caption, r.feature) == (9, 0, "c", None)
