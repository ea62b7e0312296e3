"""Transactions that arrive one after another."""
