"""Operators for preparing training text at scale.

Nothing else in the library imports this subpackage.  Conventions that hold for every
operator here:

* input tables may carry extra columns; internal columns start with ``__vx_`` so that they
  do not clash;
* a null text counts as an empty text; a null id stays null in the result;
* repeated rows are separate rows unless an operator says otherwise.
"""
