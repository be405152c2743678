"""The encoding of bodies that declare none."""

import random

import pytest

from chapterlake.sources import charsets, readers

SIMPLIFIED = "第一章　启程。他站在山门前，望着远处的群山，心中忽然明白了师父当年说过的话。少年背着剑走进城里，街上人来人往，没有谁注意到他。掌柜抬起头来，笑着问道：客官是打尖还是住店？我喜欢这本书的内容，故事写得很好看。三年之后，两人再次相遇，却都已经不是从前的模样了。"
TRADITIONAL = "第一章　啟程。她把書放回架上，轉身對老人說：這個故事我從小聽到大，卻從來沒有想過結局會是這樣。我喜歡這本書的內容。窗外下著雨，街上的燈一盞一盞亮起來。少年背著劍走進城裡，沒有誰注意到他。三年之後，兩人再次相遇，卻都已經不是從前的模樣了。"
JAPANESE = "第一章　旅立ち。彼は静かに本を閉じて、窓の外を見つめた。雨はまだ降り続いていて、町の明かりがぼんやりと滲んでいる。明日の朝には、すべてが変わっているだろう。少年は剣を背負って城下町に入ったが、誰も気にしなかった。ホテルのロビーでコーヒーを飲みながら、手紙を読んだ。"
KOREAN = "제일장 출발. 그는 산문 앞에 서서 먼 산을 바라보며 스승의 말을 떠올렸다. 소년은 검을 메고 성 안으로 들어갔지만 아무도 그를 눈여겨보지 않았다. 창밖에는 비가 내리고 거리의 불빛이 하나씩 켜졌다."
GERMAN = "Früh am Morgen gingen die Mädchen über die Brücke und grüßten den müden Händler. Größere Schiffe fuhren flussabwärts, während die Vögel schliefen."
RUSSIAN = "Он стоял у ворот и смотрел на далёкие горы, вспоминая слова учителя. За окном шёл дождь, и на улице один за другим зажигались огни."
CASES = [(SIMPLIFIED, "gb18030"), (TRADITIONAL, "big5"), (JAPANESE, "shift-jis"), (JAPANESE, "euc-jp"), (KOREAN, "euc-kr"), (GERMAN, "windows-1252"), (RUSSIAN, "windows-1251")] + [(t, f"utf-16-{e}") for t in (SIMPLIFIED, TRADITIONAL, JAPANESE, KOREAN, GERMAN, RUSSIAN) for e in ("le", "be")]


@pytest.mark.parametrize("text, name", CASES)
def test_guesses_of_longer_texts(text, name):
    rng, right, n = random.Random(3), 0, 200
    parts = [p for p in text.replace("。", "。\n").replace(". ", ". \n").split("\n") if p]
    for _ in range(n):
        made = "<p>" + str(rng.randint(0, 10**6))
        while len(made.encode(name)) < 200:
            made += rng.choice(parts)
        cut = rng.randint(0, 3)  # texts begin anywhere
        made = made[:3] + made[3 + cut :] + rng.choice(["</p>", "", "\r\n"])
        right += charsets.guess(made.encode(name)) == (name, made)
    assert right >= 0.99 * n


@pytest.mark.parametrize("name", ["gb18030", "big5"])
def test_guesses_of_short_texts(name):
    for text in ("我喜歡這本書的內容" if name == "big5" else "我喜欢这本书的内容", "第一章" * 3):
        assert charsets.guess(text.encode(name)) == (name, text)


def test_marks_modes_and_bytes_of_no_encoding():
    assert charsets.guess("﻿abc".encode()) == ("utf-8", "abc")
    assert charsets.guess("﻿中文".encode("utf-16-le")) == ("utf-16", "中文")
    assert charsets.guess(JAPANESE.encode("iso-2022-jp")) == ("iso-2022-jp", JAPANESE)
    assert charsets.guess(b"") == ("utf-8", "") and charsets.guess(b"plain") == ("utf-8", "plain")
    assert charsets.guess(b"a\0b") is not None  # read somehow, not refused


def test_decoded_pages_without_a_declared_charset(spark):
    rows = [(k, t.encode(n), "text/html") for k, (t, n) in enumerate(CASES)]
    rows += [(50, TRADITIONAL.encode("big5"), "text/html; charset=gbk2"), (51, SIMPLIFIED.encode("gb18030"), "text/html; charset=utf-8"), (52, None, None), (53, b"", None), (54, b"\x81", None), (55, "é".encode(), "text/html; charset=latin-1")]
    raw = spark.createDataFrame(rows, "page_id long, body binary, content_type string")
    got = {r["page_id"]: (r["encoding"], r["html"]) for r in readers.decode_pages(raw).collect()}
    assert all(got[k] == (n, t) for k, (t, n) in enumerate(CASES))
    assert got[50] == ("big5", TRADITIONAL) and got[51] == ("gb18030", SIMPLIFIED) and got[52][1] is None and got[53] == ("utf-8", "") and got[54][1] is not None and got[55] == ("latin-1", "Ã©")
