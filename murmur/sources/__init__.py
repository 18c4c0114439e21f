"""Readers for files, landed API payloads and Kafka."""
