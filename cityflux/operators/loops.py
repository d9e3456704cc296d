"""Loops of ``operators.trees`` on the JVM: ``Loops.java``, compiled by the compiler that Spark carries, sent to the executors as a jar."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path
from threading import Lock

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_LOADERS: dict[str, object] = {}
_LOCK = Lock()


def _loader(spark: SparkSession):
    """The class loader that holds the loops, made and sent once per application."""
    context = spark.sparkContext
    with _LOCK:
        if context.applicationId not in _LOADERS:
            compiler = spark._jvm.org.codehaus.janino.SimpleCompiler()
            compiler.cook(Path(__file__).with_name("Loops.java").read_text())
            code = compiler.getBytecodes()
            jar = f"{tempfile.mkdtemp(prefix='cityflux-loops-')}/cityflux-loops.jar"
            with zipfile.ZipFile(jar, "w") as out:
                for name in code.keySet():
                    out.writestr(f"{name.replace('.', '/')}.class", bytes(code[name]))
            context._jsc.addJar(jar)
            _LOADERS[context.applicationId] = compiler.getClassLoader()
        return _LOADERS[context.applicationId]


def new(spark: SparkSession, name: str):
    """A new object of a class of ``Loops``."""
    gateway, jvm = spark.sparkContext._gateway, spark._jvm
    kind = _loader(spark).loadClass(f"cityflux.Loops${name}")
    return kind.getConstructor(gateway.new_array(jvm.java.lang.Class, 0)).newInstance(gateway.new_array(jvm.java.lang.Object, 0))


def tasks(df: DataFrame, functions: list, schema: str) -> DataFrame:
    """Rows that functions of ``Loops`` make of all rows of a frame: each is a task of its own, which reads the frame if it has to."""
    spark, context = df.sparkSession, df.sparkSession.sparkContext
    rows = df.coalesce(1)._jdf.javaRDD()
    made = context._gateway.new_array(spark._jvm.org.apache.spark.api.java.JavaRDD, len(functions))
    for k, function in enumerate(functions):
        made[k] = rows.mapPartitions(function)
    return _frame(spark, context._jsc.union(made), schema)


def boosted(df: DataFrame, parts: int, *settings) -> bytes:
    """The nodes of boosted trees over the rows of a frame, held in at most so many tasks."""
    spark = df.sparkSession
    return bytes(new(spark, "Boost").run(spark.sparkContext._jsc, df.coalesce(parts)._jdf.javaRDD(), *settings))


def mapped(df: DataFrame, function, schema: str) -> DataFrame:
    """Rows that a function of ``Loops`` makes of each partition."""
    return _frame(df.sparkSession, df._jdf.javaRDD().mapPartitions(function), schema)


def _frame(spark: SparkSession, rows, schema: str) -> DataFrame:
    told = spark._jsparkSession.parseDataType(T._parse_datatype_string(schema).json())
    return DataFrame(spark._jsparkSession.createDataFrame(rows, told), spark)


def heap(spark: SparkSession) -> int:
    """Bytes of heap of an executor."""
    if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
        return spark._jvm.java.lang.Runtime.getRuntime().maxMemory()
    told = spark.sparkContext.getConf().get("spark.executor.memory", "1g")
    return spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(told)


def executors(spark: SparkSession) -> int:
    """Processes that hold rows."""
    known = spark.sparkContext._jsc.sc().getExecutorMemoryStatus().size()
    return known if known == 1 else known - 1
