"""Catalogs: languages by file extension, sinks, and files in which applications begin.

The sink catalog is a parameter everywhere; ``load_catalog`` reads a complete one from JSON. The built-in lists cover
the languages that have an extractor.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

# File extensions by language.
EXTENSIONS = {
    "py": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "tsx",
    "java": "java", "go": "go", "php": "php", "rb": "ruby", "cs": "c_sharp",
}

# Calls that are sinks, by language.
PYTHON = [
    "exec", "eval", "compile", "open", "execfile", "input", "__import__", "os.system", "os.popen", "os.spawn", "subprocess.Popen", "subprocess.call",
    "subprocess.run", "pickle.loads", "yaml.load", "marshal.load", "shelve.open", "sqlite3.connect", "cursor.execute", "flask.render_template_string",
    "subprocess.check_output", "commands.getoutput", "pickle.load", "marshal.loads", "cursor.executemany", "cursor.executescript", "jinja2.Template",
    "mako.template", "urllib.request.urlopen", "requests.get", "requests.post", "xml.etree.ElementTree.parse", "lxml.etree.fromstring", "shutil.rmtree",
    "os.remove", "zipfile.ZipFile.extractall", "tarfile.TarFile.extractall", "flask.redirect", "django.shortcuts.redirect", "re.compile", "re.search",
    "str.format", "format", "str.join", "join",
]
JAVASCRIPT = [
    "eval", "Function", "setTimeout", "setInterval", "child_process.exec", "child_process.spawn", "child_process.execFile", "document.write",
    "document.writeln", "innerHTML", "outerHTML", "dangerouslySetInnerHTML", "child_process.execSync", "child_process.spawnSync", "vm.runInNewContext",
    "vm.runInThisContext", "db.query", "connection.query", "sequelize.query", "res.render", "ejs.render", "pug.render", "JSON.parse", "deserialize",
    "node-serialize.unserialize", "http.request", "axios.get", "request", "fs.writeFile", "fs.unlink", "res.redirect", "window.location.href", "new RegExp",
    "RegExp", "String.prototype.concat", "Array.prototype.join",
]
TYPESCRIPT = [
    "eval", "Function", "setTimeout", "setInterval", "child_process.exec", "child_process.spawn", "child_process.execFile", "document.write",
    "document.writeln", "innerHTML", "outerHTML", "dangerouslySetInnerHTML", "child_process.execSync", "child_process.spawnSync", "vm.runInNewContext",
    "db.query", "connection.query", "res.render", "JSON.parse", "http.request", "axios.get", "fs.writeFile", "res.redirect", "new RegExp",
    "String.prototype.concat", "Array.prototype.join",
]
TSX = [
    "eval", "Function", "setTimeout", "setInterval", "child_process.exec", "child_process.spawn", "child_process.execFile", "document.write",
    "document.writeln", "innerHTML", "outerHTML", "dangerouslySetInnerHTML", "child_process.execSync", "db.query", "res.render", "http.request", "axios.get",
    "res.redirect", "new RegExp", "String.prototype.concat", "Array.prototype.join",
]
JAVA = [
    "Runtime.exec", "ProcessBuilder.start", "Statement.execute", "Statement.executeQuery", "PreparedStatement.execute", "PreparedStatement.executeQuery",
    "Runtime.getRuntime().exec", "ProcessBuilder", "ScriptEngine.eval", "Method.invoke", "Class.forName", "EntityManager.createQuery", "JdbcTemplate.query",
    "ObjectInputStream.readObject", "XMLDecoder.readObject", "new XMLDecoder", "XPathExpression.compile", "DocumentBuilderFactory.newInstance",
    "URL.openConnection", "HttpURLConnection", "RestTemplate.getForObject", "Files.write", "File.delete", "response.sendRedirect", "new RedirectView",
    "Pattern.compile", "String.matches", "String.format", "StringBuilder.append", "StringBuilder.toString",
]
PHP = [
    "exec", "system", "passthru", "shell_exec", "eval", "popen", "proc_open", "mysqli_query", "require", "require_once", "include", "include_once",
    "file_get_contents", "pcntl_exec", "assert", "create_function", "preg_replace", "mysql_query", "pg_query", "PDO->query", "PDO->prepare", "unserialize",
    "igbinary_unserialize", "simplexml_load_string", "DOMDocument->loadXML", "curl_exec", "fsockopen", "unlink", "rmdir", "move_uploaded_file", "header",
    "sleep", "usleep", "preg_match", "sprintf", "vsprintf", "printf", "vprintf",
]
GO = [
    "os.StartProcess", "exec.Command", "sql.Query", "sql.Exec", "template.Execute", "exec.CommandContext", "syscall.Exec", "db.Query", "db.Exec",
    "db.Prepare", "json.Unmarshal", "xml.Unmarshal", "gob.Decode", "template.ExecuteTemplate", "pongo2.FromString", "xml.NewDecoder", "http.Get", "http.Post",
    "net.Dial", "os.Remove", "os.WriteFile", "http.Redirect", "regexp.Compile", "fmt.Sprintf", "strings.Join",
]
RUBY = [
    "eval", "system", "exec", "syscall", "open", "send", "public_send", "spawn", "popen", "`", "%x", "instance_eval", "class_eval", "find_by_sql",
    "connection.execute", "where", "Marshal.load", "YAML.load", "Oj.load", "ERB.new", "ERB#result", "Nokogiri::XML", "REXML::Document.new", "Net::HTTP.get",
    "URI.open", "RestClient.get", "File.write", "File.delete", "IO.write", "redirect_to", "Regexp.new", "sleep", "String#%", "String#format", "Array#join",
]
C_SHARP = [
    "Process.Start", "Assembly.Load", "Type.GetType", "SqlCommand.ExecuteReader", "SqlCommand.ExecuteNonQuery", "ProcessStartInfo", "PowerShell.Invoke",
    "CodeDomProvider.CompileAssemblyFromSource", "OdbcCommand.ExecuteReader", "OleDbCommand.ExecuteNonQuery", "BinaryFormatter.Deserialize",
    "JsonConvert.DeserializeObject", "XmlSerializer.Deserialize", "XPathNavigator.Evaluate", "XPathDocument.Create", "XmlDocument.Load", "XmlReader.Create",
    "HttpClient.GetAsync", "WebRequest.Create", "File.WriteAllText", "Directory.Delete", "Response.Redirect", "RedirectToAction", "RedirectPermanent",
    "new Regex", "Regex.Match", "String.Format", "StringBuilder.Append", "StringBuilder.ToString",
]

# Sinks that the first generation of the rules doesn't have, by language.
NOT_IN_FIRST_GENERATION = {
    "python": {"str.format", "format", "str.join", "join"},
    "javascript": {"String.prototype.concat", "Array.prototype.join"},
    "typescript": {"String.prototype.concat", "Array.prototype.join"},
    "tsx": {"String.prototype.concat", "Array.prototype.join"},
    "java": {"String.format", "StringBuilder.append", "StringBuilder.toString"},
    "php": {"sprintf", "vsprintf", "printf", "vprintf"},
    "go": {"strings.Join"},
    "ruby": {"String#%", "String#format", "Array#join"},
    "c_sharp": {"String.Format", "StringBuilder.Append", "StringBuilder.ToString"},
}

# Files in which web applications begin, by language.
ENTRY_FILES = {
    "python": {"app.py", "main.py", "server.py", "urls.py", "wsgi.py", "asgi.py", "routes.py"},
    "javascript": {"app.js", "server.js", "index.js", "main.js", "routes.js", "router.js", "page.js", "_app.js"},
    "typescript": {"app.ts", "server.ts", "index.ts", "main.ts", "routes.ts", "router.ts"},
    "tsx": {"page.tsx", "_app.tsx", "layout.tsx"},
    "php": {"index.php"},
    "c_sharp": {"program.cs", "startup.cs"},
    "java": {"application.java", "main.java", "webconfig.java"},
    "go": {"main.go", "router.go", "routes.go", "server.go"},
    "ruby": {"config.ru", "routes.rb", "application.rb"},
}


SINKS = {
    "python": PYTHON, "javascript": JAVASCRIPT, "typescript": TYPESCRIPT, "tsx": TSX, "java": JAVA, "php": PHP, "go": GO, "ruby": RUBY, "c_sharp": C_SHARP,
}


def builtin_catalog(first_generation: bool = False) -> dict[str, list[str]]:
    """Sinks by language, or those of the first generation of the rules."""
    gone = NOT_IN_FIRST_GENERATION if first_generation else {}
    return {lang: [s for s in own if s not in gone.get(lang, ())] for lang, own in SINKS.items()}


def load_catalog(path: str) -> dict[str, list[str]]:
    """A catalog from a JSON object of language to list of sinks."""
    with open(path, encoding="utf-8") as file:
        return {lang: list(dict.fromkeys(own)) for lang, own in json.load(file).items()}


def normalized_sink(sink: str) -> str:
    """A catalog entry as normalised callees are written: ``::``, ``->`` and ``#`` as dots, without ``new`` and ``()``."""
    sink = sink.removeprefix("new ").replace("()", "")
    for mark in ("::", "->", "#"):
        sink = sink.replace(mark, ".")
    return sink.replace(" ", "")


def catalog_frame(spark: SparkSession, catalog: dict[str, list[str]] | None = None, compat: bool = False) -> DataFrame:
    """(lang, sink); entries as given if ``compat``, else normalised, so that all of them can match."""
    rows = {(lang, s if compat else normalized_sink(s)) for lang, own in (catalog or builtin_catalog()).items() for s in own}
    return spark.createDataFrame(sorted(rows), "lang string, sink string")
