"""papyrine: document-record analytics as Spark DataFrame operators."""
