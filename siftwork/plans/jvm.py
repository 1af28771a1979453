"""Functions in Java: compiled in the driver by the compiler that Spark has for its own plans, and sent to executors as a jar."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile

from pyspark import SparkContext
from pyspark.sql import SparkSession

_made: dict[tuple[object, str], tuple[object, str]] = {}
_sent: set[tuple[str, str]] = set()


def register(spark: SparkSession, source: str, name: str) -> None:
    """Register in this session the functions of class `name` in the Java source; its method `register` names them."""
    sc = spark.sparkContext
    # once a JVM, which applications that follow one another share: the gateway takes classes of one name for one class
    if (sc._gateway, name) not in _made:
        _made[sc._gateway, name] = _compile(sc, source, name)
    functions, jar = _made[sc._gateway, name]
    if (sc.applicationId, name) not in _sent:
        sc._jsc.addJar(jar)  # the driver serves it to executors, also to those that start later
        _sent.add((sc.applicationId, name))
    functions.register(spark._jsparkSession)


def _compile(sc: SparkContext, source: str, name: str) -> tuple[object, str]:
    """An object of the class, and a jar that holds it."""
    compiler = sc._jvm.org.codehaus.janino.SimpleCompiler()
    compiler.setParentClassLoader(sc._jsc.getClass().getClassLoader())
    compiler.cook(source)
    folder = tempfile.mkdtemp(prefix="siftwork-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    jar = f"{folder}/{name}.jar"
    with zipfile.ZipFile(jar, "w") as out:
        for each, code in dict(compiler.getBytecodes()).items():
            out.writestr(each.replace(".", "/") + ".class", bytes(code))
    made = compiler.getClassLoader().loadClass(name).getDeclaredConstructor(sc._gateway.new_array(sc._jvm.Class, 0))
    return made.newInstance(sc._gateway.new_array(sc._jvm.Object, 0)), jar
