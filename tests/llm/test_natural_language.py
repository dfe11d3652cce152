import pytest

from loomwright.llm.natural_language import find_language, fit_model, gram_counts, language_shares
from loomwright.llm.pieces import pieces, unescape

SENTENCES = {
    "en": ["The value must be checked before the list is written to disk.", "Each order keeps its number until the clerk has closed it.", "Do not call this method while the lock is held by another thread.", "When the import fails the line number and the cause are kept for the report."],
    "de": ["Der Wert muss geprüft werden, bevor die Liste geschrieben wird.", "Jeder Auftrag behält seine Nummer, bis der Prüfer ihn schließt.", "Nicht aufrufen, solange die Sperre von einem anderen gehalten wird.", "Wenn die Einfuhr fehlschlägt, bleiben Zeile und Ursache erhalten."],
    "fr": ["La valeur doit être vérifiée avant que la liste soit écrite.", "Chaque commande garde son numéro jusqu'à ce que le contrôleur la ferme.", "Ne pas appeler tant que le verrou est tenu par un autre.", "Si l'import échoue, la ligne et la cause sont conservées."],
    "es": ["El valor debe comprobarse antes de escribir la lista.", "Cada pedido conserva su número hasta que el revisor lo cierra.", "No llamar mientras otro mantenga el bloqueo.", "Si la importación falla, se conservan la línea y la causa."],
    "zh": ["写入列表之前必须先检查数值是否正确。", "审核员关闭之前每张订单保留自己的编号。", "持有锁的时候不要调用这个方法。"],
    "ja": ["リストに書き込む前に値を確認しなければならない。", "担当者が閉じるまで注文は番号を保持する。"],
    "ru": ["Перед записью списка значение необходимо проверить.", "Каждый заказ сохраняет номер, пока проверяющий его не закроет."],
    "ko": ["목록에 쓰기 전에 값을 먼저 확인해야 한다.", "담당자가 닫을 때까지 주문은 번호를 유지한다."],
}

JAVA = '''package a;
// The list must be checked before the order is written.
class A {
    int x = f(a, b); // TODO
    /* Der Auftrag muss geprüft werden,
     * bevor er geschrieben wird. */
    String s = "\\u8ba2\\u5355\\u5199\\u5165\\u4e4b\\u524d\\u5fc5\\u987b\\u68c0\\u67e5";
    String q = "SELECT id, name FROM orders WHERE qty > 0 AND state = 'X' ORDER BY id";
    // for (int i = 0; i < n; i++) total += list.get(i);
    // return foo(bar(x), y);
    String u = "http://host.example/api/v1/orders/{id}/lines", c = "ok", d = "已完成";
    char e = '"'; // 목록에 쓰기 전에 값을 확인한다
}
'''

PYTHON = """def f(x):
    '''La valeur doit être vérifiée avant.

    :param x: int
    '''
    y = f"Si la importación falla, se conserva la línea {x}"  # pylint: disable=invalid-name
    #リストに値を書き込む
    return "# Перед записью значение необходимо проверить"
"""


@pytest.fixture(scope="module")
def fitted(spark):
    docs = spark.createDataFrame([(lang.upper() if k else lang, s) for lang, ss in SENTENCES.items() for k in range(12) for s in ss] + [(None, "x"), ("xx", "y"), ("en", None), ("en", "")], "lang string, text string")
    code = spark.createDataFrame([("a.java", JAVA), ("b.py", PYTHON), (None, None)], "path string, code string")
    return fit_model(gram_counts(code, docs))


def test_places_kinds_and_languages(spark, fitted):
    rows = [("j", "src/A.JAVA", JAVA, "x"), ("j", "src/A.JAVA", JAVA, "x"), ("c", "A.java", JAVA.replace("\n", "\r\n"), "x"), ("p", "b.py", PYTHON, "x"), ("n", "b.py", None, "x"), ("e", None, "", "x"), ("l", "c.go", "x := 1\n" * 20_000 + "// each order keeps its number until the clerk has closed it", "x")]
    got = find_language(spark.createDataFrame(rows, "case_id string, path string, code string, kind string"), fitted)
    found = {(r.case_id, r.line_no, r.kind, r.nl_lang) for r in got.collect()}
    java = {(2, "comment", "en"), (5, "comment", "de"), (7, "string", "zh"), (12, "comment", "ko")}
    assert {f[1:] for f in found if f[0] == "j"} == java and {f[1:] for f in found if f[0] == "c"} == java
    assert {f[1:] for f in found if f[0] == "p"} == {(2, "string", "fr"), (6, "string", "es"), (7, "comment", "ja"), (8, "string", "ru")}
    assert {f for f in found if f[0] in "nel"} == {("l", 20_001, "comment", "en")}
    shares = {(r.case_id, r.nl_lang): r.share for r in language_shares(got.distinct()).collect()}
    assert 0.05 < shares["j", "en"] < 0.2 and len(shares) == 13
    assert find_language(got.sparkSession.createDataFrame([], "case_id string, path string, code string"), fitted).count() == 0


def test_unescape():
    assert unescape(r"中\x41\n\U0001F600\"") == '中A 😀"'
    assert unescape(r"\xe4\xb8\xad\346\226\207") == "中文"
    assert unescape(r"😀 \u{4e2d}") == "😀 中"
    assert unescape("\\u4e2") == " 4e2" and unescape("a\\") == "a\\"


def test_pieces():
    assert pieces('a "x//y" // z "q"\n/* b\n*/ R"(c")"', "cpp") == [(1, "string", "x//y"), (1, "comment", ' z "q"'), (2, "comment", " b\n"), (3, "string", 'c"')]
    assert pieces("`a\nb` 'c' \"d\" //e", "go") == [(1, "string", "a\nb"), (2, "string", "d"), (2, "comment", "e")]
    assert pieces("x = rb'a' # b\n'''c\nd''' \"e\\\"f\"", "python") == [(1, "string", "a"), (1, "comment", " b"), (2, "string", "c\nd"), (3, "string", 'e\\"f')]
    assert pieces("/* open", "java") == [(1, "comment", " open")] and pieces("", "java") == []
