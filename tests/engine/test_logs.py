"""Parsing against a plain sequential simulator, and the log source."""

import json
import os
import random

import pytest

from botlantern.config import Config
from botlantern.plans.parse import events_of, on_disk, parse_logs
from botlantern.sources.logs import BotLogSource, BotLogStreamReader, discover_after, discover_recent, last_line_end, read_lines, sort_key

SCHEMA = "stream string, file string, offset long, value string"
T0 = 1_704_067_200_000


def line(name, content, ts, **more):
    return json.dumps({"name": name, "content": content, "timestamp": ts} | more, ensure_ascii=False)


def parse(spark, lines, config=None, files=None):
    rows = [("s", (files or {}).get(i, "2024-01-01-1.log"), i, v) for i, v in enumerate(lines)]
    p = parse_logs(spark.createDataFrame(rows, SCHEMA), config, keep=on_disk)
    try:
        return p.ai.collect(), p.images.collect(), {r.outcome: r.lines for r in p.outcomes.collect()}
    finally:
        p.known.unpersist()


CHAT = "[聊天模型] [gpt-4]"
FINISH = "🏁 [流式] 传输完成 | 总耗时: 1234ms | 输入: 100 | 输出: 200"


def test_outcomes(spark):
    ai, images, outcomes = parse(spark, ["not-json", line("who", "x", T0), line(CHAT, "🚀 [请求开始] [流式] 模型: gpt-4", T0), "[1]", "null", '{"name": 5, "content": "x", "timestamp": 1}', line(CHAT, {"a": 1}, T0)])
    assert (ai, images, outcomes) == ([], [], {"invalid": 1, "ignored": 6})


def test_pairing(spark):
    start = "🚀 [请求开始] [流式] 模型: gpt-4"
    ai, _, outcomes = parse(spark, [line(CHAT, start, T0), line(CHAT, "🌊 流式传输已开始 | 延迟: 77ms", T0 + 5), line(CHAT, FINISH, T0 + 1500), line("[心跳处理器] x", FINISH, T0 + 1501), line(CHAT, FINISH, T0 + 1600)])
    assert len(ai) == 2 and outcomes == {"ai": 2, "ignored": 3}
    first, second = sorted(ai, key=lambda r: r.timestamp)
    assert (first.id, first.totalTokens, first.latencyMs, first.firstTokenLatencyMs, first.success, first.provider) == (f"yes-{T0}-gpt-4-{len(start) + 1}", 300, 1234, 77, True, "cpa")
    assert (first.date, first.hour) == (19723, 0)
    assert second.id == f"yes-{T0 + 1600}-gpt-4-{len(FINISH) + 1}" and second.firstTokenLatencyMs is None


def test_failures(spark):
    name = "[请求执行器][chat]:[deepseek-r1]"
    ai, _, _ = parse(spark, [line(CHAT, "💬 [流式] 模型未输出有效内容", T0), line(name, "请求失败 | 错误:  boom " + "x" * 200, T0), line(name, "请求失败", T0 + 1), line(name, "请求失败 错误: a\nb", T0 + 2), line(name, "请求失败\n错误: late", T0 + 3)])
    codes = {r.id.split("-")[1]: r.errorCode for r in ai if r.provider == "deepseek"}
    assert codes == {str(T0): ("boom " + "x" * 200)[:100], str(T0 + 1): "UNKNOWN", str(T0 + 2): "UNKNOWN", str(T0 + 3): "late"}
    assert [r.errorCode for r in ai if r.provider == "cpa"] == ["OUTPUT_EMPTY_CONTENT"]


def test_model_context(spark):
    usage = "Token usage from API: input=1 output=2 total=3"
    name = "chatluna-x"
    ai, _, _ = parse(
        spark,
        [line(name, usage, T0), line(name, "\x1b[32m使用模型： deepseek/chat\x1b[0m, x", T0), line(name, usage, T0 + 299_999), line(name, usage, T0 + 300_000), line(name, "modelId=openai/o1", T0 + 300_001), line(name, usage, T0 + 300_002), line(name, "model: x " + usage, T0 + 4), line("chat-luna", usage, T0)],
        Config(default_model="default/model"),
    )
    assert sorted((r.timestamp.timestamp() * 1000 - T0, r.modelId, r.provider) for r in ai if r) == [(0, "model", None), (299_999, "chat", "deepseek"), (300_000, "model", None), (300_002, "o1", "openai")]


def test_image_context(spark):
    ctx = "记录指令调用 | 用户: ann | 指令: draw cat | 频道: qq:12"
    gen = "aka-ai-image-generator"
    ask = "requestProviderImages 调用 { provider: 'p', modelId: 'm', numImages: 3 }"
    lines = [line("[世界状态] x", ctx, T0), line(gen, ask, T0 + 1), line(gen, "provider=p event=edit_failed", T0 + 2), line(gen, "provider=p event=create_success", T0 + 3), line(gen, "provider=p event=create_success", T0 + 120_000), line(gen, ask.replace("3", "0"), T0 + 5), line(gen, "provider=p event=edit_success", T0 + 6), line("UsageReporter", "provider=p event=edit_success", T0)]
    _, images, _ = parse(spark, lines)
    got = sorted((r.id, r.userId, r.commandName, r.platform, r.modelId, r.numImages, r.success) for r in images)
    assert got == sorted([
        (f"img-{T0 + 2}-p-fail", "ann", "draw cat", "qq", "m", 3, False), (f"img-{T0 + 3}-p-ok", "ann", "draw cat", "qq", "m", 3, True),
        (f"img-{T0 + 120_000}-p-ok", None, None, None, None, 1, True), (f"img-{T0 + 6}-p-ok", "ann", "draw cat", "qq", "m", 1, True),
    ])
    assert parse(spark, lines, Config(enable_ai_stats=False))[1] and not parse(spark, lines, Config(enable_image_stats=False))[1]
    assert not parse(spark, [line(CHAT, FINISH, T0)], Config(tracked_sources={"yesimbot": False}))[0]


def read_event(value):
    """(status, name, content, timestamp) by Python's reader."""

    def reject(constant):
        raise ValueError(constant)

    try:
        found = json.loads(value or "", parse_constant=reject)
    except (ValueError, RecursionError):
        return "invalid", None, None, None
    if not isinstance(found, dict):
        return "other", None, None, None
    text = lambda k: found.get(k) if isinstance(found.get(k), str) else None
    at = found.get("timestamp")
    return "object", text("name"), text("content"), float(at) if isinstance(at, (int, float)) and not isinstance(at, bool) else None


def odd_lines():
    rng = random.Random(4)
    sound = ['{"name":"a","content":"b","timestamp":1700000000000}', line("é\u2028", "x\"]}\\", T0), "[1]", "null", '"s"', "1", "-0.5e3", "[]", "{}", '[{"a":[1,{"b":"]"}]}]', ' {"name" : "n" ,\t"content":"c]","timestamp":1.5e3}\r']
    found = sound + ["", " ", None, "x", "nul", "01", "1.", ".5", "+1", "NaN", "-Infinity", "'a'", "{a:1}", '{"a":1,}', "[1,]", "[,1]", '"\t"', '"\\x"', '"\\u12"', "/*c*/1", "1//c", "\ufeff1", "1\x00", "\x0b1", "{\"a\"}", '{"a":1', '"open', "tru", "True"]
    found += [s + t for s in sound for t in (" ", "1", ",1", "]", "}", "],[2", '},{"v":2', "]]", "}}", '],"x":[1', ' ] {"v":1}', "] }", "} ]", ', "x": 1', "]x", "[", "{", "\n", "//", ",")]
    found += [t + s for s in sound for t in ("]", "}", "[", "{", "1,", "],", '"v":', "1],[", '1},{"v":')]
    found += ['{"name":"a","name":"b","content":"c","timestamp":1,"timestamp":2}', '{"name":5,"content":"c","timestamp":1}', '{"name":"n","content":["c"],"timestamp":1}', '{"name":null,"content":null,"timestamp":null}']
    found += [f'{{"name":"n","content":"c","timestamp":{t}}}' for t in ("true", '"5"', "0", "-0", "0.0", "0.5", "-5", "1e3", "1E400", "1e30", "12345678901234567890", "9007199254740993", "1.7e12", "123456789012345678901234567890123456789012", "[1]", "{}")]
    found += ['{"name":"n","content":"\\u00e9\\ud83d\\ude00\\n\\/","timestamp":1}', '{"name":"","content":"c","timestamp":1}', '{"Name":"n","content":"c","timestamp":1}', '{"a":{"name":"n"},"name":"m","content":"c","timestamp":3}', '{"na.me":1,"name":"n","content":"c","timestamp":3}', "[" * 200 + "]" * 200, "[" * 200 + "]" * 201]
    letters = '{}[]",:1a \\'
    return found + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 7))) for _ in range(3000)]


def test_strict_json_agrees_with_another_reader(spark):
    lines = odd_lines()
    rows = spark.createDataFrame(list(enumerate(lines)), "i int, value string")
    found = events_of(rows)
    assert "Python" not in found._jdf.queryExecution().toString()
    got = {r.i: (r.status, r.name, r.content, r.ts) for r in found.collect()}
    for i, value in enumerate(lines):
        status, name, content, at = read_event(value)
        filled = name and content and at and abs(at) < 2**63
        assert got[i] == (status, *((name, content, int(at)) if filled else (None,) * 3)), value


def test_lone_surrogates_and_limits_of_json(spark):
    lines = ['{"name":"n\\ud800","content":"c","timestamp":1}', "[" * 1500 + "]" * 1500, "1" * 1500, line("n", "x" * 3_000_000, T0)]
    got = events_of(spark.createDataFrame(list(enumerate(lines)), "i int, value string")).orderBy("i").collect()
    assert [r.status for r in got] == ["object", "invalid", "invalid", "object"] and got[0].ts == 1 and len(got[3].content) == 3_000_000


def simulate(lines):
    """A plain parser that goes line by line."""
    calls, asked, mention, command, ai, images = {}, {}, None, None, [], []
    for value in lines:
        status, name, content, ts = read_event(value)
        if not (status == "object" and name and content and ts):
            continue
        ts = int(ts)
        if name.startswith("[聊天模型]"):
            m = name.split("[")[2].rstrip("]")
            units = len(content.encode("utf-16-le")) // 2
            if "请求开始" in content:
                calls[m] = [ts, units, None]
            elif "已开始" in content:
                if m in calls:
                    calls[m][2] = int(content.split()[-1][:-2])
            else:
                c = calls.pop(m, [ts, units, None])
                ai.append((f"yes-{c[0]}-{m}-{c[1]}", c[2], "完成" in content))
        elif name == "chatluna":
            if content.startswith("model"):
                mention = (content[7:], ts)
            else:
                m = mention[0] if mention and ts - mention[1] < 300_000 else "unknown"
                ai.append((f"cl-{ts}-{m}-1-2", None, True))
        elif name.startswith("[世界状态]"):
            command = (content.split(" | ")[1][4:], ts)
        elif "调用" in content:
            asked[content.split("'")[1]] = int(content.split()[-2])
        else:
            p, ok = content.split()[0][9:], "success" in content
            n = (asked.pop(p, None) if ok else asked.get(p)) or 1
            images.append((f"img-{ts}-{p}-{'ok' if ok else 'fail'}", n, command[0] if command and ts - command[1] < 120_000 else None))
    return sorted(ai, key=str), sorted(images, key=str)


def random_log(seed, n=400):
    rng, ts, out = random.Random(seed), T0, []
    for _ in range(n):
        ts += rng.choice([1, 1000, 40_000, 200_000])
        m, p = rng.choice("ab"), rng.choice("xy")
        out.append(rng.choice([
            line(f"[聊天模型] [{m}]", "🚀 [请求开始]" + "é" * rng.randint(0, 3), ts), line(f"[聊天模型] [{m}]", f"🌊 流式传输已开始 | 延迟: {rng.randint(1, 99)}ms", ts), line(f"[聊天模型] [{m}]", FINISH, ts), line(f"[聊天模型] [{m}]", "OUTPUT_EMPTY_CONTENT", ts),
            line("chatluna", f"model: m{rng.randint(0, 9)}", ts), line("chatluna", "Token usage from API: input=1 output=2 total=3", ts),
            line("[世界状态]", f"记录指令调用 | 用户: u{rng.randint(0, 9)} | 指令: c | 频道: qq:1", ts), line("aka-ai-image-generator", f"requestProviderImages 调用 provider: '{p}', numImages: {rng.randint(0, 4)} }}", ts),
            line("aka-ai-image-generator", f"provider={p} event=create_success", ts), line("aka-ai-image-generator", f"provider={p} event=edit_failed", ts), "junk",
        ]))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_windows_equal_a_sequential_parser_over_many_files(spark, seed):
    lines = random_log(seed)
    names = [f"2024-01-0{1 + k // 12}-{k % 12 + 1}.log" for k in range(40)]
    files = {i: names[i // 10] for i in range(len(lines))}
    ai, images, _ = parse(spark, lines, files=files)
    want_ai, want_images = simulate(lines)
    assert sorted(((r.id, r.firstTokenLatencyMs, r.success) for r in ai), key=str) == want_ai
    assert sorted(((r.id, r.numImages, r.userId) for r in images), key=str) == want_images


def test_file_order_and_discovery(tmp_path):
    names = ["2024-01-02-10.log", "2024-01-02-9.log", "2023-12-31-100.log", "other.log", "2024-01-02-9.txt"]
    for n in names:
        (tmp_path / n).write_text("x\n")
    (tmp_path / "2025-01-01-1.log").mkdir()
    order = ["other.log", "2023-12-31-100.log", "2024-01-02-9.log", "2024-01-02-10.log"]
    assert sorted(order, key=sort_key) == order
    assert [f.name for f in discover_recent(str(tmp_path), 2)] == order[2:]
    assert [f.name for f in discover_after(str(tmp_path), None, 3)] == order[:3]
    assert [f.name for f in discover_after(str(tmp_path), "2024-01-02-9.log", 3)] == order[3:]
    many = [f"2024-01-{d:02}-{i}.log" for d in range(1, 29) for i in range(1000)]
    assert discover_recent(str(tmp_path), 5, lambda _: many + ["noise.log"]) == []
    with pytest.raises(FileNotFoundError):
        discover_recent(str(tmp_path / "none"), 2)


@pytest.mark.parametrize("chunk", [1, 5, 1000])
def test_lines_of_byte_ranges(tmp_path, chunk):
    path = tmp_path / "2024-01-01-1.log"
    raw = "één\r\n\n  日本語 line \nthird\ntail".encode()
    path.write_bytes(raw)
    whole = list(read_lines(str(path), 0, len(raw), True, chunk))
    assert [t for _, t in whole] == ["één", "日本語 line", "third", "tail"]
    assert [t for _, t in read_lines(str(path), 0, len(raw), False, chunk)] == ["één", "日本語 line", "third"]
    for cut in range(len(raw) + 1):
        parts = [*read_lines(str(path), 0, cut, True, chunk), *read_lines(str(path), cut, len(raw), True, chunk)]
        assert parts == whole
    end = raw.rindex(b"\n") + 1
    assert last_line_end(str(path), 0, len(raw), chunk) == end and last_line_end(str(path), end, len(raw), chunk) == end
    assert last_line_end(str(path), 0, 2, chunk) == raw.index(b"\n") + 1


def test_stream_offsets(tmp_path):
    path = tmp_path / "2024-01-01-1.log"
    path.write_text("one\ntwo\nthr")
    reader = BotLogStreamReader(str(tmp_path), {})
    start = reader.initialOffset()
    first = reader.latestOffset()
    read = lambda a, b: [r[3] for p in reader.partitions(a, b) for r in reader.read(p)]
    assert read(start, first) == ["one", "two"]
    with path.open("a") as f:
        f.write("ee\nfour\n")
    second = reader.latestOffset()
    assert read(first, second) == ["three", "four"] and read(second, reader.latestOffset()) == []
    path.write_text("new\n")
    assert read(second, reader.latestOffset()) == ["new"]
    os.utime(path, (1_600_000_000, 1_600_000_000))
    third = reader.latestOffset()
    assert read({"files": {path.name: {"pos": 4, "size": 4, "mtime": 1_700_000_000_000}}}, third) == ["new"]
    limited = BotLogStreamReader(str(tmp_path), {"maxBytesPerFile": "5", "maxFiles": "1"})
    path.write_text("aa\nbb\ncc\n")
    a = limited.initialOffset()
    got = []
    for _ in range(4):
        b = limited.latestOffset()
        got += [r[3] for p in limited.partitions(a, b) for r in limited.read(p)]
        a = b
    assert got == ["aa", "bb", "cc"]
    with pytest.raises(ValueError, match="positive"):
        BotLogStreamReader(str(tmp_path), {"maxFiles": "0"})


def test_batch_source(spark, tmp_path):
    spark.dataSource.register(BotLogSource)
    (tmp_path / "2024-01-01-1.log").write_text("a\nb\nend")
    (tmp_path / "2024-01-01-2.log").write_text("c\n")
    rows = spark.read.format("botlog").load(str(tmp_path)).collect()
    assert sorted((r.file, r.offset, r.value) for r in rows) == [("2024-01-01-1.log", 0, "a"), ("2024-01-01-1.log", 2, "b"), ("2024-01-01-1.log", 4, "end"), ("2024-01-01-2.log", 0, "c")]
    assert spark.read.format("botlog").option("names", "2024-01-01-2.log").load(str(tmp_path)).count() == 1


def test_options_of_a_query_reach_the_source(spark, tmp_path):
    """Spark hands options over in lower case."""
    for i in range(1, 6):
        (tmp_path / f"2024-01-01-{i}.log").write_text("x\n")
    spark.dataSource.register(BotLogSource)
    rows = spark.readStream.format("botlog").option("maxFiles", 3).load(str(tmp_path))
    query = rows.writeStream.format("memory").queryName("three_files").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r.file for r in spark.table("three_files").collect()) == [f"2024-01-01-{i}.log" for i in (3, 4, 5)]


def test_a_backlog_passes_no_file_over(tmp_path):
    put = lambda name, *values: (tmp_path / f"2024-01-0{name}.log").write_text("".join(v + "\n" for v in values))
    read = lambda a, b, r: [x[3] for p in r.partitions(a, b) for x in r.read(p)]

    def batches(at, **options):
        """What each batch reads, each by a reader of its own, until nothing is new."""
        found = []
        while True:
            reader = BotLogStreamReader(str(tmp_path), {"maxFiles": "2", "backlog": "true", "known": json.dumps(at), **options})
            end = reader.latestOffset()
            assert len(end["files"]) <= 4
            if end == at:
                return found, at
            found, at = [*found, read(at, end, reader)], end

    for n in range(1, 6):
        put(f"1-{n}0", f"a{n}", f"b{n}")
    put("1-30")
    found, end = batches({"files": {}})
    assert found == [["a1", "b1", "a2", "b2"], ["a4", "b4"], ["a5", "b5"]]
    # What the files that are followed say comes first, then a late file between them and new ones; a file that was let go stays so.
    for n in (1, 4, 5):
        put(f"1-{n}0", f"a{n}", f"b{n}", f"c{n}")
    for name in ("1-60", "2-1", "2-2", "1-45"):
        put(name, name)
    found, end = batches(end)
    assert found == [["c4", "c5"], ["1-45", "1-60"], ["2-1", "2-2"]]
    # The newest files, as a stream that goes on after the backlog takes them: nothing comes again.
    reader = BotLogStreamReader(str(tmp_path), {"maxFiles": "2", "known": json.dumps(end)})
    assert read(end, reader.latestOffset(), reader) == []
    # A file that the limits leave half read is read on before later ones.
    put("3-1", "a", "b", "c")
    put("3-2", "d", "e")
    put("3-3", "f")
    (tmp_path / "2024-01-03-3.log").open("a").write("no end")
    assert batches(end, maxLinesPerFile="2")[0] == [["a", "b"], ["c"], ["d", "e", "f"]]
    with pytest.raises(ValueError, match="known"):
        BotLogStreamReader(str(tmp_path), {"backlog": "true"})
