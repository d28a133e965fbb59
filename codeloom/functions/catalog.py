"""What counts as a source, a sink and a sanitizer of untrusted data: ordered tables, the first match of a table decides.

One line an entry: name | qualified name or - | kind | label or severity |
patterns | more. More entries can be given wherever a catalogue is used.
"""

from __future__ import annotations

from dataclasses import dataclass

EXACT, CONTEXT, NAME, WEAK = 0.95, 0.85, 0.7, 0.5


@dataclass(frozen=True)
class Entry:
    """label holds a source's taint label or a sink's severity; removes the labels a sanitizer takes away; params the argument places a sink trusts."""

    name: str
    qualified: str | None
    kind: str
    label: str
    patterns: tuple[str, ...]
    removes: tuple[str, ...] = ()
    params: tuple[int, ...] = (0,)
    confidence: float = 1.0


def _lines(text: str) -> list[list[str]]:
    return [[c.strip() for c in line.split("|")] for line in text.strip().splitlines()]


SOURCES = tuple(
    Entry(a, None if q == "-" else q, k, lab, tuple(p.split()), confidence=float(c))
    for a, q, k, lab, p, c in _lines("""
input | - | user_input | user | input raw_input | 1
sys.argv | sys.argv | sys_argv | user | sys.argv | 1
os.environ | os.environ | env_var | env | os.environ os.getenv | 1
flask.request.args | flask.request.args | flask_request | user | request.args flask.request.args | .9
flask.request.form | flask.request.form | flask_request | user | request.form flask.request.form | .9
flask.request.json | flask.request.json | flask_request | user | request.json flask.request.json | .9
flask.request.data | flask.request.data | flask_request | user | request.data flask.request.data | .9
open().read | - | file_read | file | read readline readlines | .8
requests.get | requests.get | network_read | network | requests.get requests.post requests.request | .8
socket.recv | socket.recv | network_read | network | socket.recv sock.recv | .9
""")
)

SINKS = tuple(
    Entry(a, None if q == "-" else q, k, sev, tuple(p.split()), params=tuple(int(x) for x in v.split()))
    for a, q, k, sev, p, v in _lines("""
os.system | os.system | command_exec | high | os.system | 0
os.popen | os.popen | command_exec | high | os.popen | 0
subprocess.run | subprocess.run | command_exec | high | subprocess.run subprocess.call subprocess.check_call subprocess.check_output | 0
subprocess.Popen | subprocess.Popen | command_exec | high | subprocess.Popen | 0
eval | - | code_eval | critical | eval | 0
exec | - | code_eval | critical | exec | 0
compile | - | code_eval | high | compile | 0
__import__ | - | code_eval | high | __import__ | 0
cursor.execute | - | sql_exec | high | cursor.execute connection.execute db.execute | 0
cursor.executemany | - | sql_exec | high | cursor.executemany connection.executemany | 0
open().write | - | file_write | medium | write writelines | 0
render_template_string | flask.render_template_string | template_render | high | render_template_string flask.render_template_string | 0
Template().render | - | template_render | medium | Template Jinja2.Template | 0
requests.get | requests.get | http_request | medium | requests.get requests.post requests.request | 0
urllib.urlopen | - | http_request | medium | urllib.request.urlopen urllib.urlopen urllib2.urlopen | 0
pickle.loads | pickle.loads | serialization | high | pickle.loads pickle.load cPickle.loads | 0
logging | - | log_output | low | logging.info logging.debug logging.warning logging.error | 0
os.path.join | os.path.join | path_traversal | medium | os.path.join pathlib.Path | 0 1
""")
)

SANITIZERS = tuple(
    Entry(a, None if q == "-" else q, k, "", tuple(p.split()), removes=tuple(r.split()))
    for a, q, k, r, p in _lines("""
shlex.quote | shlex.quote | shell_escape | user file env | shlex.quote pipes.quote
html.escape | html.escape | html_escape | user file | html.escape cgi.escape markupsafe.escape
urllib.parse.quote | urllib.parse.quote | url_encode | user | urllib.parse.quote urllib.quote urllib.parse.quote_plus
os.path.normpath | os.path.normpath | path_normalize | user file | os.path.normpath os.path.abspath Path.resolve
int | - | type_cast | user | int
float | - | type_cast | user | float
str.isdigit | - | regex_validate | user | isdigit isalpha isalnum
re.match | re.match | regex_validate | user | re.match re.fullmatch re.search
""")
)

#: Kinds of modules by the beginning of their names. The last three tell nothing about a call and are only listed.
MODULES = {
    "command_execution": "commands distutils.spawn os platform popen2 pty subprocess",
    "code_evaluation": "__builtin__ builtins code imp importlib",
    "sql_database": "MySQLdb django.db mysql peewee psycopg2 pymongo pymysql sqlalchemy sqlite3",
    "serialization": "dill jsonpickle marshal pickle shelve yaml",
    "network": "aiohttp http.client httplib requests socket urllib urllib2 urllib3",
    "web_framework": "bottle cherrypy django fastapi flask pyramid starlette tornado web",
    "template_engine": "cheetah django.template jinja2 mako",
    "file_io": "io pathlib shutil tempfile",
    "logging": "logging syslog warnings",
}
MODULES = {k: tuple(v.split()) for k, v in MODULES.items()}
TOLD = tuple(MODULES)[:7]

SINK_WORDS = {
    "command": "call cmd command exec invoke popen process run shell spawn system",
    "code": "compile eval exec import load",
    "sql": "alter create cursor delete drop execute insert query select sql update",
    "write": "dump save store write writelines",
    "network": "connect fetch get post put request send sendall urlopen",
    "template": "format_string render substitute template",
    "serialization": "deserialize load loads unmarshal unpickle",
}
SINK_WORDS = {k: tuple(v.split()) for k, v in SINK_WORDS.items()}
SOURCE_WORDS = {
    "input": "get_input input raw_input read_input stdin",
    "cli": "argparse args arguments argv sys.argv",
    "env": "env environ environment getenv",
    "web": "args body cookies data form headers json params query request values",
    "file": "load open read readline readlines",
    "network": "download fetch get receive recv recvfrom",
}
SOURCE_WORDS = {k: tuple(v.split()) for k, v in SOURCE_WORDS.items()}
SANITIZER_WORDS = {
    "escape": "clean encode escape htmlescape quote safe sanitize urlencode",
    "validation": "assert check ensure filter is_safe is_valid validate verify",
    "normalization": "abspath canonical normalize normpath realpath",
    "conversion": "bool float int parse_float parse_int str to_int to_number",
}
SANITIZER_WORDS = {k: tuple(v.split()) for k, v in SANITIZER_WORDS.items()}

#: Modules of which any call is a sink: category and severity.
DANGEROUS = {
    "os": ("command_exec", "high"), "subprocess": ("command_exec", "high"), "commands": ("command_exec", "medium"), "pty": ("command_exec", "medium"),
    "pickle": ("deserialization", "high"), "marshal": ("deserialization", "high"), "shelve": ("deserialization", "medium"), "yaml": ("deserialization", "medium"),
}
BUILTINS_EVALUATING = ("__import__", "compile", "eval", "exec")
WEB_ACCESS = tuple("request." + x for x in "GET POST args cookies data form json values".split())
#: Constructors of objects that read or write, in the order they are tried.
IO_OBJECTS = tuple(
    tuple(line)
    for line in _lines("""
open | file
file | file
io.open | file
socket.socket | socket
socket.create_connection | socket
requests.get | http_response
requests.post | http_response
requests.request | http_response
urllib.request.urlopen | http_response
urllib2.urlopen | http_response
http.client.HTTPConnection | http_response
sqlite3.connect | database_cursor
psycopg2.connect | database_cursor
subprocess.Popen | process
subprocess.run | process
""")
)
#: Built-in functions a call graph knows by name.
BUILTINS = tuple(
    """abs all any bin bool chr compile dict dir enumerate eval exec filter float getattr globals hasattr hex input int
    isinstance iter len list locals map max min next oct open ord pow print range reversed round set setattr sorted str sum
    tuple type vars zip""".split()
)
SEVERITIES = ("low", "medium", "high", "critical")


def entries_of(entries: tuple[Entry, ...], kind: str | None = None, label: str | None = None) -> list[Entry]:
    """Entries of a kind, and with a taint label or severity."""
    return [e for e in entries if kind in (None, e.kind) and label in (None, e.label)]


def entry_named(entries: tuple[Entry, ...], name: str) -> Entry | None:
    return next((e for e in entries if e.name == name), None)


def severity_of(name: str, entries: tuple[Entry, ...] = SINKS) -> str:
    """Severity of a sink; medium for one that is unknown."""
    e = entry_named(entries, name)
    return e.label if e else "medium"


def trusts(e: Entry, place: int) -> bool:
    """Whether a sink trusts the argument at a place; one without places trusts all."""
    return not e.params or place in e.params


def effective(e: Entry, labels: set[str]) -> bool:
    """Whether a sanitizer takes away any of the labels."""
    return bool(set(e.removes) & labels)


def all_modules() -> set[str]:
    return {m for names in MODULES.values() for m in names}
