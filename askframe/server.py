"""The engine over HTTP, with the standard library only: JSON endpoints below /api and one plain page."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, unquote, urlparse

from askframe.engine import Engine

PAGE = """<!doctype html><meta charset="utf-8"><title>askframe</title>
<style>body{font:16px system-ui;max-width:60rem;margin:2rem auto}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:.2rem .5rem}pre{background:#f4f4f4;padding:.5rem}</style>
<h1>askframe</h1><form id="f"><input id="q" size="60" placeholder="how many customers are there"> <button>Ask</button> <label><input type="checkbox" id="dry"> SQL only</label> <button type="button" id="v">Speak</button> <button type="button" id="t">Retrain</button></form>
<p id="e"></p><pre id="s"></pre><div id="r"></div><div id="a"></div><h2>History</h2><ul id="h"></ul>
<h2>Databases</h2><ul id="d"></ul><form id="n"><input name="name" placeholder="name" required> <input name="path" placeholder="Parquet folder or JDBC URL"> or <select name="dialect"><option>postgres<option>mysql</select>
<input name="host" placeholder="host"> <input name="port" placeholder="port" size="5"> <input name="dbname" placeholder="database"> <input name="username" placeholder="user"> <input name="password" type="password" placeholder="password"> <button>Add</button></form>
<script>
const $=i=>document.getElementById(i), t=x=>document.createTextNode(x), el=(n,x)=>{const e=document.createElement(n);if(x!==undefined)e.append(t(x));return e};
async function history(){const r=await(await fetch('/api/history?limit=20')).json();$('h').replaceChildren(...r.map(x=>{const e=el('li',x.question+' ('+x.status+')');e.onclick=()=>{$('q').value=x.question};return e}))}
$('f').onsubmit=async ev=>{ev.preventDefault();const r=await(await fetch('/api/ask',{method:'POST',body:JSON.stringify({question:$('q').value,execute:!$('dry').checked})})).json();
$('e').textContent=(r.error||r.explanation)+' ['+r.confidence+']';$('s').textContent=r.sql;const b=el('table');const h=el('tr');(r.columns||[]).forEach(c=>h.append(el('th',c)));b.append(h);
(r.rows||[]).forEach(x=>{const w=el('tr');x.forEach(v=>w.append(el('td',v)));b.append(w)});$('r').replaceChildren(b);
$('a').replaceChildren(...(r.alternatives||[]).map(a=>{const e=el('button',a.explanation);e.onclick=()=>{$('s').textContent=a.sql};return e}));history()};history();
const call=async(m,p,b)=>{const r=await(await fetch(p,{method:m,body:m==='GET'?undefined:JSON.stringify(b||{})})).json();$('e').textContent=r.error||'';return r};
async function databases(){const r=await call('GET','/api/databases');$('d').replaceChildren(...r.map(x=>{const e=el('li',x.name+' ('+x.dialect+', '+x.table_count+' tables)'+(x.is_active?' active':''));
[['activate','POST'],['regenerate','POST'],['delete','DELETE']].forEach(([w,m])=>{const b=el('button',w);b.onclick=async()=>{await call(m,'/api/databases/'+encodeURIComponent(x.name)+(m==='POST'?'/'+w:''));databases()};e.append(b)});return e}))}
$('n').onsubmit=async ev=>{ev.preventDefault();await call('POST','/api/databases',Object.fromEntries(new FormData($('n'))));databases()};
$('t').onclick=async()=>{const r=await call('POST','/api/train');$('e').textContent=r.error||('trained on '+r.examples+' questions')};
const Heard=window.SpeechRecognition||window.webkitSpeechRecognition;if(Heard)$('v').onclick=()=>{const s=new Heard();s.onresult=x=>{$('q').value=x.results[0][0].transcript;$('f').requestSubmit()};s.start()};else $('v').hidden=true;
databases();
</script>"""


def route(engine: Engine, method: str, path: str, query: dict, body: dict) -> tuple[int, object]:
    """Status and JSON of a request."""
    parts = [unquote(p) for p in path.strip("/").split("/")]
    try:
        match method, parts:
            case "POST", ["api", "ask"]:
                return 200, engine.ask(str(body.get("question", "")), bool(body.get("execute", True)))
            case "GET", ["api", "health"]:
                return 200, engine.health()
            case "GET", ["api", "schema"]:
                return 200, engine.schema()
            case "GET", ["api", "history"]:
                return 200, engine.history(int(query.get("limit", ["50"])[0]))
            case "POST", ["api", "train"]:
                return 200, engine.train()
            case "GET", ["api", "databases"]:
                return 200, engine.databases()
            case "POST", ["api", "databases"]:
                if engine.registry.get(str(body.get("name", ""))):
                    return 409, {"error": "a database of this name exists"}
                more = {k: body[k] for k in ("dialect", "host", "port", "dbname", "username", "password") if body.get(k)}
                db = engine.register(str(body["name"]), body.get("path") or None, **more)
                return 201, {"name": db.name, "table_count": db.table_count}
            case "POST", ["api", "databases", name, "activate"]:
                engine.activate(name, str(body.get("password", "")))
                return 200, {"active": name}
            case "POST", ["api", "databases", name, "regenerate"]:
                return 200, {"name": name, "table_count": engine.regenerate(name)}
            case "DELETE", ["api", "databases", name]:
                return (200, {"deleted": name}) if engine.unregister(name) else (404, {"error": "no such database"})
    except KeyError as e:
        return 404, {"error": f"not found: {e}"}
    except ValueError as e:
        return 400, {"error": str(e)}
    except Exception as e:  # one request's failure is its answer
        return 500, {"error": str(e).splitlines()[0][:300]}
    return 404, {"error": "no such endpoint"}


def serve(engine: Engine, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    """A server, not yet running; call ``serve_forever``."""

    class Handler(BaseHTTPRequestHandler):
        def _answer(self) -> None:
            url = urlparse(self.path)
            if self.command == "GET" and url.path in ("/", "/index.html"):
                data, kind, status = PAGE.encode(), "text/html; charset=utf-8", 200
            else:
                try:
                    body = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or b"{}")
                except ValueError:
                    body = None
                status, out = route(engine, self.command, url.path, parse_qs(url.query), body) if isinstance(body, dict) else (400, {"error": "not a JSON object"})
                data, kind = json.dumps(out, default=str).encode(), "application/json"
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = do_DELETE = _answer

        def log_message(self, *args: object) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
