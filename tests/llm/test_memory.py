"""What a worker holds: little beside the texts of a piece, and nothing of an encoder that is no longer used."""

import gc
import tracemalloc
import weakref

import numpy as np
import pyarrow as pa

from visiloom.llm import arrays, bpe, toxicity


def peak(run) -> int:
    arrays.release()
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_an_encoder_goes_with_its_last_use():
    encoder = bpe.PrefixBpe({bytes([i]): i for i in range(256)} | {b"ab": 256})
    assert encoder.ids_of(pa.array(["ab a", None]))[0].tolist() == [256, 32, 97]
    gc.disable()  # only references count
    try:
        alive = weakref.ref(encoder)
        del encoder
        assert alive() is None
    finally:
        gc.enable()


def test_hashes_take_little_beside_the_text():
    word = np.frombuffer(b"some words ", dtype=np.uint8)
    buf = np.tile(word, 200_000)
    ends = np.flatnonzero(buf == 32)
    starts = np.append(0, ends[:-1] + 1)
    assert peak(lambda: arrays.span_hashes(buf, starts, ends)) < 8 * len(starts) + 16e6


def test_pieces_of_texts_take_little():
    text = "some words of a sentence. And more of them! " * 80
    table = pa.RecordBatch.from_arrays([pa.array([text] * 1000)], names=["text"])
    encoder = bpe.PrefixBpe({bytes([i]): i for i in range(256)})

    def run(module, each):
        for piece in module.slices(table, 0, module.PIECE):
            each(piece.column(0))

    assert peak(lambda: run(toxicity, toxicity.words_of)) < 60e6
    assert peak(lambda: run(bpe, encoder.ids_of)) < 40e6
