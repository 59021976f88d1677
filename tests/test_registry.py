"""Properties source (A4), enabled predicate (C4) and derivative registry."""

from relaysync.operators.derivatives import routes_registry
from relaysync.sources.properties import load_settings, read_properties


def test_properties_override_and_registry(spark, tmp_path):
    a = tmp_path / "default.properties"
    b = tmp_path / "site.properties"
    a.write_text("# defaults\nerror.maxRedeliveries=5\nhttp.additional_options=x=1\n"
                 "derivative.systems.installed=conv, ocr,,ghost\n"
                 "derivative.conv.enabled=true\nderivative.conv.in.stream=queue:conv\n"
                 "derivative.conv.service.url=http://svc.test/conv?a=b=c\n"
                 "derivative.ocr.in.stream=queue:ocr\nderivative.ocr.service.url=http://svc.test/ocr\n")
    b.write_text("error.maxRedeliveries=2\nderivative.ocr.enabled=TRUE\n")
    paths = [str(a), str(b), str(tmp_path / "missing.properties")]
    s = load_settings(spark, paths)
    assert s.max_redeliveries == 2 and s.http_options == "x=1"
    reg = {r.item: r for r in routes_registry(read_properties(spark, paths)).collect()}
    assert set(reg) == {"conv", "ocr"}  # ghost has no properties -> dropped
    assert reg["conv"].service_url == "http://svc.test/conv?a=b=c"  # split at the first '='
    assert reg["conv"].enabled and reg["ocr"].enabled
    assert reg["ocr"].route == "derivative.ocr"


def test_key_aliases(spark, tmp_path):
    f = tmp_path / "site.properties"
    f.write_text("site.queue.node=queue:n\nsite.base=http://svc.test/base\nindexer.delete=queue:d\n")
    s = load_settings(spark, [str(f)], aliases={"site.queue.node": "indexer.node", "site.base": "indexer.service.baseUrl"})
    assert (s.node_stream, s.service_base_url, s.delete_stream) == ("queue:n", "http://svc.test/base", "queue:d")
    assert s.triples_index_stream == "queue:n"


def test_properties_format(spark, tmp_path):
    from relaysync.sources.properties import resolve
    f = tmp_path / "fmt.properties"
    f.write_text(
        "   # indented comment\n"
        "! bang comment\n"
        "a=1\n"
        "b : two words  \n"
        "c three\n"
        "d=line one \\\n"
        "    continued\n"
        "e\\=x=y\n"
        "f=back\\\\\n"
        "g=tab\\tend\n"
        "h = http://svc.test/x?a=b\n"
        "empty=\n"
        "# a comment does not continue \\\n"
        "i=C:\\\\temp\n"
        "j=x\\\n"
        "  #y\n"
    )
    got = {r.key: r.value for r in resolve(read_properties(spark, [str(f)])).collect()}
    assert got == {"a": "1", "b": "two words  ", "c": "three", "d": "line one continued", "e=x": "y",
                   "f": "back\\", "g": "tab\tend", "h": "http://svc.test/x?a=b", "empty": "",
                   "i": "C:\\temp", "j": "x#y"}


def test_enabled_words(spark, tmp_path):
    f = tmp_path / "en.properties"
    lines = ["derivative.systems.installed=a,b,c,d,e,f"]
    for item, val in zip("abcdef", ["yes", " ON ", "1", "", "maybe", None]):
        if val is not None:
            lines.append(f"derivative.{item}.enabled={val}")
        lines += [f"derivative.{item}.in.stream=q:{item}", f"derivative.{item}.service.url=http://svc.test/{item}"]
    f.write_text("\n".join(lines) + "\n")
    reg = {r.item: r.enabled for r in routes_registry(read_properties(spark, [str(f)])).collect()}
    assert reg == {"a": True, "b": True, "c": True, "d": False, "e": False, "f": False}
    from relaysync.settings import read_bool
    assert [read_bool(v, True) for v in [None, "", "Yes", "off", "x"]] == [True, False, True, False, False]


def test_unicode_escapes(spark, tmp_path):
    f = tmp_path / "u.properties"
    f.write_text("a=caf\\u00e9\\u0020x\nsmile=\\uD83D\\uDE00!\nhalf=\\uD83Dz\nshort=\\u00g1\nk\\u0065y=v\n")
    got = {r["key"]: r["value"] for r in read_properties(spark, [str(f)]).collect()}
    assert got == {"a": "caf\u00e9 x", "smile": "\U0001F600!", "half": "\\uD83Dz", "short": "\\u00g1", "key": "v"}
