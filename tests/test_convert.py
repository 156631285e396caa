"""Phrases by longest match and bytes of unknown encodings, against plain versions."""

import random

import pytest

from millrace.functions import convert as C


def plain(text, table):
    out, at = "", 0
    while at < len(text):
        best = max((p for p in table if p and text.startswith(p, at)), key=len, default=None)
        out, at = (out + table[best], at + len(best)) if best else (out + text[at], at + 1)
    return out


@pytest.mark.parametrize("seed", range(30))
def test_longest_phrase_first(seed):
    import re

    rng = random.Random(seed)
    table = {"".join(rng.choices("ab優惠", k=rng.randint(1, 4))): rng.choice(["X", "", "a", "ba"]) for _ in range(rng.randint(1, 8))}
    trie = C.phrase_trie(table)
    heads = re.compile("[" + "".join(map(re.escape, trie)) + "]")
    for _ in range(50):
        text = "".join(rng.choices("abc優惠領", k=rng.randint(0, 30)))
        assert C.converted(text, trie, heads) == plain(text, table)


def test_phrases_of_a_column(spark):
    df = spark.createDataFrame([("頭髮發展",), ("",), (None,), ("]^-",)], "t string")
    got = [r[0] for r in df.select(C.convert_phrases(df.t, {"頭髮": "头发", "髮": "发", "發": "发", "]": ")", "^": "(", "": "never"})).collect()]
    assert got == ["头发发展", "", None, ")(-"]
    assert [r[0] for r in df.select(C.convert_phrases(df.t, {})).collect()][0] == "頭髮發展"


def slow_cost(line, encoding):
    """Place by place."""
    if encoding == "utf-8":
        return 10.0 * line.decode("utf-8", "replace").count("�")
    cost, k, runs = 0.0, 0, [0]  # runs: of characters that stand together
    while k < len(line):
        b = line[k]
        if b < 0x80:
            runs.append(0)
            k += 1
        elif encoding == "gb18030":
            two = line[k : k + 2]
            four = line[k : k + 4]
            if len(two) == 2 and 0x81 <= b <= 0xFE and (0x40 <= two[1] <= 0x7E or 0x80 <= two[1] <= 0xFE):
                cost += 0 if two[1] >= 0xA1 and two[1] <= 0xFE and (0xB0 <= b <= 0xD7 or 0xA1 <= b <= 0xA3) else 1.5
                runs[-1] += 1
                k += 2
            elif len(four) == 4 and 0x81 <= b <= 0xFE and 0x30 <= four[1] <= 0x39 and 0x81 <= four[2] <= 0xFE and 0x30 <= four[3] <= 0x39:
                cost += 1.5
                runs[-1] += 1
                k += 4
            else:
                cost += 10
                # what stood alone before an invalid byte is invalid with it
                runs[-1] = 0
                k += 1
        else:
            cost += 10 if b in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else 2 if b < 0xA0 else 0.6 if b < 0xC0 or b in (0xD7, 0xF7) else 0.3
            cost += 0.5 if k and line[k - 1] >= 0x80 else 0
            k += 1
    return cost + 1.2 * runs.count(1)


@pytest.mark.parametrize("seed", range(20))
def test_costs_are_as_told(seed):
    rng = random.Random(seed)
    for _ in range(60):
        line = bytes(rng.choice([rng.randrange(256), rng.randrange(0x80, 0x100), 0x61, 0x30]) for _ in range(rng.randrange(12)))
        assert all(C.encoding_cost(line, e) == pytest.approx(slow_cost(line, e)) for e in C.ENCODINGS)


def test_bytes_of_several_encodings(spark):
    lines = [("微信支付优惠领取", "gb18030"), ("Été à Genève, café crème", "cp1252"), ("naïve “quotes” – dash", "cp1252"), ("plain", "ascii"), ("中文 und Straße", "utf-8"), ("这是一个测试文件，包含中文标点。", "gb18030")]
    raw = b"\n".join(t.encode(e) for t, e in lines)
    df = spark.createDataFrame([(bytearray(raw),), (None,), (bytearray(b""),), (bytearray(b"ok \xff\xfe\x00"),), (bytearray("é".encode() + b" \x81"),)], "raw binary")
    got = [r[0] for r in df.select(C.decode_mixed(df.raw)).collect()]
    assert got[0] == "\n".join(t for t, _ in lines) and got[1] is None and got[2] == ""
    assert got[3].startswith("ok ") and got[4].endswith("�")  # invalid bytes are replaced


def test_accented_letters_in_a_row_before_plain_ones():
    from millrace.functions.convert import decoded_line

    assert decoded_line("Éèêpa.".encode("cp1252")) == "Éèêpa."
    for text in ("微信支付优惠领取", "朱镕基 said", "优惠abc", "a 中文 b"):
        assert decoded_line(text.encode("gb18030")) == text


def test_lines_of_accented_letters_alone():
    from millrace.functions.convert import decoded_line

    for text in ("Éçêè", "ÉÉÈÇ!!", "LEÈÈÇÊ!!", "OUÉÇÉÇ!!", "Ñóíá", "ÄÖÜÖ", "éèêç"):
        assert decoded_line(text.encode("cp1252")) == text
    for text in ("中国", "测试", "优惠", "社会", "我们", "你好", "社 abc 会", "ABC微信"):
        assert decoded_line(text.encode("gb18030")) == text
