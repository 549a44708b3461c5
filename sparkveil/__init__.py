"""PySpark-native detection and reversible masking of personal data in Japanese text."""
