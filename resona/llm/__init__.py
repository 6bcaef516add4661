"""Operators for preparing training data at corpus scale, one module each.

``entries`` lists the registered queries; nothing outside this subpackage
imports it.
"""
