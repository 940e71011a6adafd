"""Schemas of what is read and written. JSON is never inferred."""

from pyspark.sql import types as T

ENGLISH_DOC = T.StructType([T.StructField("text", T.StringType()), T.StructField("language_score", T.DoubleType())])
PLAIN_DOC = T.StructType([T.StructField("text", T.StringType())])
MESSAGES = T.StructType([T.StructField("messages", T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])))])
INSTRUCTION = T.StructType([T.StructField(n, T.StringType()) for n in ("instruction", "context", "response")])
INPUT_TARGET = T.StructType([T.StructField(n, T.StringType()) for n in ("inputs", "targets")])
TRANSLATION = T.StructType([T.StructField(n, T.StringType()) for n in ("input_text", "output_text")])
TOKENS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("tokens", T.ArrayType(T.IntegerType()))])
DOC_OFFSETS = T.StructType([T.StructField("source", T.StringType()), T.StructField("doc_id", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("length", T.LongType())])
MERGES = T.StructType([T.StructField("rank", T.IntegerType()), T.StructField("left", T.IntegerType()), T.StructField("right", T.IntegerType()), T.StructField("new_id", T.IntegerType()), T.StructField("n", T.LongType())])
VOCAB = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("bytes", T.BinaryType()), T.StructField("is_special", T.BooleanType())])
