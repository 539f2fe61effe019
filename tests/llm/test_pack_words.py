"""Word ids of packing: plain words are encoded without a special token between them, and every word gets its own ids."""

import numpy as np

from fleetlens.llm import op6_pack


class Recorder:
    def __init__(self, tokenizer):
        self.tokenizer, self.texts = tokenizer, []

    def encode_batch_fast(self, texts, **options):
        self.texts += texts
        return self.tokenizer.encode_batch_fast(texts, **options)

    def encode(self, *args, **options):
        return self.tokenizer.encode(*args, **options)


def test_words_are_cut_at_their_own_endings():
    words = op6_pack.WordIds(op6_pack.VOCABULARY)
    recorder = words._tokenizer = Recorder(words._tokenizer)
    odd = ["a.b", "don't", ".a", "À×b", "İ", "ﬁ", "é", "x\x01y", "12", "....", "a_b", words._cut[0] + "q"]
    plain = ["Hallo.", "Ärger?!", "ÿÞ.", "ß", "SS", "a", "a.", "a..", "quedoci.", "Zzyzxqv;", "abc!?"]
    found = words._encoded(odd + plain)
    for w in odd + plain:
        assert found[w] == np.array(recorder.tokenizer.encode(w, add_special_tokens=False).ids, "<u4").tobytes(), w
    assert recorder.texts[0] == " ".join(plain)


def test_a_vocabulary_that_breaks_the_count_is_encoded_as_before():
    words = op6_pack.WordIds(op6_pack.VOCABULARY)
    want = words._encoded(["Hallo.", "b"])
    words._ends = np.zeros_like(words._ends)  # no token ends a run
    words._ends[np.frombuffer(want["b"], "<u4")] = True
    assert words._told(["Hallo.", "b"]) == {} and words._encoded(["Hallo.", "b"]) == want
